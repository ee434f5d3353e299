"""DuckDB SQL for the queries of `queries`, written apart from them over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def u(*keys: str) -> str:
    return f"(cast(('0x'||substr(md5(concat_ws(':',{','.join(keys)})),1,12))::UBIGINT as double)/281474976710656.0)"


def add(name: str, body: str, columns: str, *parts: str) -> None:
    """columns: names with :b (bigint), :d (double, 6 places), :s (string), :t (boolean)."""
    kinds = {"b": "cast({0} as bigint)", "d": "round(cast({0} as double), 6)", "s": "cast({0} as varchar)", "t": "cast({0} as boolean)"}
    out = ", ".join(f'{kinds[k].format(chr(34) + c + chr(34))} as "{c}"' for c, k in (x.split(":") for x in columns.split()))
    rec = "recursive " if any("recursive_" in p for p in parts) else ""
    ORACLES[name] = (f"with {rec}" + ",\n".join(parts) + "\n" if parts else "") + f"select {out} from ({body}) q_"


CALLS = """calls as (select sample, pop, cast(site // 16 as bigint) as locus, cast(site as bigint) as site,
  case when v < -0.125 then 0 when v < 0 then 1 when v < 0.125 then 2 else 3 end as allele
  from (select vec_id as sample, cast(label as bigint) as pop, unnest(range(len(embedding))) as site, cast(unnest(embedding) as double) as v from embeddings))"""
MISS = f"mcalls as (select sample, pop, locus, site, case when {u(chr(39) + 'miss' + chr(39), 'sample', 'site')} >= 0.05 then allele end as allele from calls)"
ANC = "anc as (select locus, site, allele as anc from calls where sample = 0)"
LETTER = lambda c: f"case {c} when 0 then 'A' when 1 then 'C' when 2 then 'G' when 3 then 'T' else 'N' end"
ALTS = "alts as (select locus, site, list_reverse_sort(list(distinct allele)) as seen from mcalls where allele is not null group by 1, 2)"
ALTA = "alta as (select a.locus, a.site, anc, list_filter(seen, lambda x: x <> anc) as alts from alts a join anc using (locus, site))"
GENO = "geno as (select c.locus, c.sample, c.pop, c.site, case when allele is null then null when allele = anc then 0 else list_position(alts, allele) end as gt from mcalls c join alta using (locus, site))"
DIPL = """dipl as (select sample, pop, case when max(k) over () <= 1 then cast(pop as varchar) else pop || '_' || (k // 2) end as individual, k % 2 as side
  from (select sample, pop, row_number() over (partition by pop order by sample) - 1 as k from (select distinct sample, pop from calls)))"""
SIDES = """sides as (select locus, site, individual, max(case when side = 0 then gt end) as l, case when max(side) = 0 then max(case when side = 0 then gt end) else max(case when side = 1 then gt end) end as r
  from geno join dipl using (sample) group by 1, 2, 3)"""
GT = lambda a, b: f"coalesce(cast({a} as varchar), '.') || '|' || coalesce(cast({b} as varchar), '.')"
POINTS = "points as (select user_id as locus, event_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) // 1000000 as position, event_type as kind, ts from events)"
INTER = f"""inter as (select locus, position as start, "end", "end" - position as nbps, greatest(0, floor({u("'snps'", 'event_id')} * 8) - 5) as nsnps, tidx, kind as genealogy
  from (select *, lead(position) over (partition by locus order by ts, event_id) as "end", row_number() over (partition by locus order by ts, event_id) - 1 as tidx from points) where "end" is not null)"""
I_COLS = "locus:b start:b end:b nbps:b nsnps:b tidx:b genealogy:s"
NODES = """nodes0 as (select 's' || s_suppkey as name, 'n' || s_nationkey as parent, 0.0::double as height, cast(1000 * (1 + s_nationkey) as double) as ne from supplier
  union all select 'n' || n_nationkey, 'r' || n_regionkey, 1e5, 1000 * (1 + n_nationkey) from nation union all select 'r' || r_regionkey, 'root', 2e5, 1000 from region union all select 'root', null, 3e5, 1000),
tn as (select row_number() over (order by a.name) as idx, a.name, a.parent, a.height, p.height as up_height, p.height - a.height as dist, a.ne, not exists (select 1 from nodes0 c where c.parent = a.name) as is_leaf
  from nodes0 a left join nodes0 p on a.parent = p.name)"""
SAMPLES = """smp as (select *, row_number() over (order by name) as rank from (select name as pop, k, name || '_' || k as name from (select name, unnest(range(0, idx % 3 + 1)) as k from tn where is_leaf)))"""
CLOSURE = """clo as (select name, name as ancestor, 0 as depth from tn union all select t.name, t.parent, 1 from tn t where t.parent is not null
  union all select t.name, p.parent, 2 from tn t join tn p on t.parent = p.name where p.parent is not null
  union all select t.name, g.parent, 3 from tn t join tn p on t.parent = p.name join tn g on p.parent = g.name where g.parent is not null)"""

add("rng_uniform", f"select o_orderkey, {u(chr(39) + 'rng' + chr(39), 'o_orderkey')} as u from orders", "o_orderkey:b u:d")
add("categorical_draw", f"select event_id, case when x < 0.1 then 0 when x < 0.1::double + 0.2::double then 1 when x < 0.1::double + 0.2::double + 0.3::double then 2 else 3 end as code from (select event_id, {u(chr(39) + 'draw' + chr(39), 'event_id')} as x from events)", "event_id:b code:b")
TIMES = f"""times as (select tree, k, sum(-ln({u("'kingman'", 'tree', 'k')} + 0.5 / 281474976710656.0) / (k * (k - 1) / 2 / 2000.0)) over (partition by tree order by k desc) as time
  from (select c_custkey as tree, unnest(range(2, 7)) as k from customer))"""
add("kingman_times", "select * from times", "tree:b k:b time:d", TIMES)
COAL = """coal as (select tree, time, k, k * (k - 1) / 2 as npairs, time - coalesce(lag(time) over (partition by tree order by time), 0) as waited from times)"""
add("coal_intervals", "select * from coal", "tree:b time:d k:b waited:d npairs:d", TIMES, COAL)
add("kingman_loglik", "select tree, sum(ln(1 / 2400.0::double) - npairs * waited / 2400) as logp from coal group by 1", "tree:b logp:d", TIMES, COAL)
add("kingman_grid", "select ne, -sum(ln(1 / (2 * ne)) - npairs * waited / (2 * ne)) as loss from coal, (select unnest(range(1, 9)) * 500.0::double as ne) g group by 1", "ne:d loss:d", TIMES, COAL)

add("tree_nodes", "select * from tn", "idx:b name:s parent:s height:d up_height:d dist:d ne:d is_leaf:t", NODES)
add("samples_expand", "select * from smp", "pop:s k:b name:s rank:b", NODES, SAMPLES)
add("popfile", "select pop || chr(9) || name as value from smp", "value:s", NODES, SAMPLES)
add("imap", "select pop, pop || ': ' || string_agg(name, ',' order by name) as line from smp group by 1", "pop:s line:s", NODES, SAMPLES)
add("tree_ancestors", "select name, ancestor, depth from up", "name:s ancestor:s depth:b", NODES, "recursive_marker as (select 1)", "up as (select name, name as ancestor, 0 as depth from tn union all select up.name, tn.parent, depth + 1 from up join tn on up.ancestor = tn.name where tn.parent is not null)")
add("tree_mrca", "select a, b, arg_min(x.ancestor, x.depth) as mrca, min(x.depth) as depth_a from (select 's' || s_suppkey as a, 's' || (s_suppkey + 1) as b from supplier) p join clo x on x.name = a join clo y on y.name = b and y.ancestor = x.ancestor group by 1, 2", "a:s b:s mrca:s depth_a:b", NODES, CLOSURE)
add("monophyly", """select g."group", min(c.ancestor) as ancestor, min(c.ancestor) is not null as is_monophyletic from
  (select "group", list_sort(list(distinct tip)) as tips from (select 's' || s_suppkey as tip, 'n' || s_nationkey as "group" from supplier union all select 's' || s_suppkey, 'm' || (s_suppkey % 7) from supplier) group by 1) g
  left join (select ancestor, list_sort(list(distinct c.name)) as tips from clo c join tn on tn.name = c.name and tn.is_leaf group by 1) c on c.tips = g.tips group by 1""", "group:s ancestor:s is_monophyletic:t", NODES, CLOSURE)
add("edges_at_time", "select time, count(*) as nedges, string_agg(name, ',' order by name) as names from (select unnest(range(0, 8)) * 50000.0::double as time) t join tn on height <= time and (up_height is null or time < up_height) group by 1", "time:d nedges:b names:s", NODES)
add("asof_edge", "select tip, time, arg_max(ancestor, height) as edge, max(height) as edge_height from (select 's' || s_suppkey as tip, abs(s_acctbal) * 32 as time from supplier) p join clo on clo.name = tip join (select name, height from tn) n on n.name = ancestor where height <= time group by 1, 2", "tip:s time:d edge:s edge_height:d", NODES, CLOSURE)
PAIRS = "a.name as src, b.name as dest, greatest(a.height, b.height) as lo0, least(a.up_height, b.up_height) as hi0 from tn a join tn b on a.name <> b.name and a.parent is not null and b.parent is not null and greatest(a.height, b.height) < least(a.up_height, b.up_height)"
add("edge_overlap", f"select src, dest, lo0 as lo, hi0 as hi from (select {PAIRS} and a.parent <> b.parent)", "src:s dest:s lo:d hi:d", NODES)
add("admix_edges", f"select src, dest, lo0 + 0.25 * (hi0 - lo0) as lo, lo0 + 0.75 * (hi0 - lo0) as hi from (select {PAIRS})", "src:s dest:s lo:d hi:d", NODES)
add("recomb_map", "select cast(p_partkey as double) as position, (1 - cos(10 * pi() * p_partkey / max(p_partkey) over ())) * (5.0 - 0.001) / 2 + 0.001 as recomb_rate from part", "position:d recomb_rate:d")
add("recomb_map_drawn", f"select position, (1 - cos(10 * pi() * position / 1e6)) * (5.0 - 0.001) / 2 + 0.001 as recomb_rate from (select {u(chr(39) + 'map' + chr(39), chr(39) + 'position' + chr(39), 'p_partkey')} * 1e6 as position from part union all values (0.0), (1e6))", "position:d recomb_rate:d")
LEAF = "leaf as (select l_orderkey as tree, l_linenumber, l_partkey, l_suppkey, max(l_quantity) as dist from lineitem group by all), sup as (select tree, l_suppkey, max(dist) as far from leaf group by all)"
add("tree_scalars", "select tree, n + m + 1 as nnodes, n as ntips, len + m as total_length, far + 1 as tree_height from (select tree, count(*) as n, sum(dist) as len, max(dist) as far from leaf group by tree) a join (select tree, count(*) as m from sup group by tree) b using (tree)", "tree:b nnodes:b ntips:b total_length:d tree_height:d", LEAF)
add("names_minus", "select distinct o_custkey as name from orders where o_custkey not in (select user_id from events)", "name:b")
add("breakpoint_sessions", """select locus, min(position) as start, max(position) + 86400 as "end", count(*) as n from
  (select *, sum(new) over (partition by locus order by ts, event_id) as k from (select *, case when ts - lag(ts) over (partition by locus order by ts, event_id) < interval 1 day then 0 else 1 end as new from points)) group by locus, k""", "locus:b start:b end:b n:b", POINTS)
add("theta_table", "select name as node, 4 * ne as theta from tn", "node:s theta:d", NODES)
add("names_intersect", "select o_custkey as name from orders intersect select user_id from events", "name:b")
add("names_except", "select c_custkey as name from customer where c_custkey not in (select o_custkey from orders)", "name:b")
add("trait_scale", "select c_custkey, replace(n_name, '_', ' ') as label, greatest(1000, 100000 * x / max(x) over ()) as ne from (select c_custkey, c_nationkey, nullif(round(c_acctbal), -999) as x from customer) c join nation on n_name = 'NATION_' || c_nationkey where x > 0", "c_custkey:b label:s ne:d")
add("param_grid", "select nsites, neff, rep from (select distinct p_size as nsites from part), (select n_nationkey as neff from nation), (select r_regionkey as rep from region) where not exists (select 1 from supplier where s_suppkey % 50 + 1 = nsites and s_nationkey = neff)", "nsites:b neff:b rep:b")

PI = "hp as (select p_partkey, kappa, t, x0/(x0+x1+x2+x3) as p0, x1/(x0+x1+x2+x3) as p1, x2/(x0+x1+x2+x3) as p2, x3/(x0+x1+x2+x3) as p3 from (select p_partkey, 0.5::double + p_size / 10.0::double as kappa, p_retailprice / 2000 as t, " + ", ".join(f"0.1::double + {u(chr(39) + 'pi' + chr(39), 'p_partkey', str(i))} as x{i}" for i in range(4)) + " from part))"
HKY = """hk as (select p_partkey, kappa, t, [p0, p1, p2, p3] as p, kappa * (p0 * p2 + p1 * p3) / ((p0 + p2) * (p1 + p3)) as ts_tv, 1 / (2 * (kappa * (p0 * p2 + p1 * p3) + (p0 + p2) * (p1 + p3))) as b, i, j, i % 2 = j % 2 as near, case when j % 2 = 0 then p0 + p2 else p1 + p3 end as cls
  from hp, (select unnest(range(4)) as i), (select unnest(range(4)) as j))"""
add("hky_qmat", "select p_partkey, ts_tv, i, j, case when i <> j then b * p[j + 1] * (case when near then kappa else 1 end) else -b * ((1 - cls) + kappa * (cls - p[j + 1])) end as q from hk", "p_partkey:b ts_tv:d i:b j:b q:d", PI, HKY)
add("hky_pmat", """select p_partkey, i, j, case when not near then p[j + 1] * (1 - exp(-b * t))
  when i = j then p[j + 1] + p[j + 1] * (1 / cls - 1) * exp(-b * t) + (cls - p[j + 1]) / cls * exp(-b * t * (1 + cls * (kappa - 1)))
  else p[j + 1] + p[j + 1] * (1 / cls - 1) * exp(-b * t) - p[j + 1] / cls * exp(-b * t * (1 + cls * (kappa - 1))) end as p from hk""", "p_partkey:b i:b j:b p:d", PI, HKY)
add("rate_bins", "select event_id, bin, avg(value) over (partition by bin) as rate from (select event_id, value, least(floor((value - min(value) over ()) / ((max(value) over () - min(value) over ()) / 8)), 7) as bin from events where value is not null)", "event_id:b bin:b rate:d")

add("filter_nsnps", "select * from inter where nsnps > 1", I_COLS, POINTS, INTER)
add("first_tree", "select * from inter where tidx = 0", I_COLS, POINTS, INTER)
BUILD = "(select c_custkey from customer where c_mktsegment = 'BUILDING')"
add("subset_semi", f"select * from inter where locus in {BUILD}", I_COLS, POINTS, INTER)
add("subset_anti", f"select c_custkey as locus from {BUILD} where c_custkey not in (select locus from inter)", "locus:b", POINTS, INTER)
add("locus_summary", 'select locus, min(start) as start, max("end") as "end", sum(nbps) as nbps, sum(nsnps) as nsnps from inter group by 1', "locus:b start:b end:b nbps:b nsnps:b", POINTS, INTER)
add("trees_per_locus", "select avg(n) as mean_trees, count(*) as nloci from (select count(*) as n from inter group by locus)", "mean_trees:d nloci:b", POINTS, INTER)
add("interval_stats", "select genealogy, count(*) as n, avg(nbps) as mean, stddev_samp(nbps) as std from inter group by 1", "genealogy:s n:b mean:d std:d", POINTS, INTER)
add("nbps_histogram", """select b.bin, lo + b.bin * w as lo, lo + (b.bin + 1) * w as hi, coalesce(n, 0) as n, coalesce(n, 0) / (total * w) as density from (select unnest(range(20)) as bin) b cross join e
  left join (select cast(least(floor((nbps - lo) / w), 19) as bigint) as bin, count(*) as n from inter, e group by 1) c using (bin)""", "bin:b lo:d hi:d n:b density:d", POINTS, INTER, "e as (select min(nbps)::double as lo, (max(nbps) - min(nbps)) / 20.0::double as w, count(*) as total from inter)")
add("empty_loci", "select count(*) filter (n = 0) as nempty, count(*) as nloci, 100.0 * count(*) filter (n = 0) / count(*) as percent from (select sum(nsnps) as n from inter group by locus)", "nempty:b nloci:b percent:d", POINTS, INTER)
add("distinct_loci", "select count(distinct locus) as nloci, count(distinct genealogy) as ntrees from inter", "nloci:b ntrees:b", POINTS, INTER)
add("breakpoint_intervals", 'select * from (select locus, position as start, lead(position) over w as "end", lead(position) over w - position as nbps, row_number() over w - 1 as tidx from (select distinct locus, position from points) window w as (partition by locus order by position)) where "end" is not null', "locus:b start:b end:b nbps:b tidx:b", POINTS)
add("site_to_tree", 'select o_orderkey, s.locus, site, start, "end", tidx from (select o_orderkey, o_custkey % 150 as locus, o_orderkey * 7919 % 2592000 as site from orders) s join inter i on i.locus = s.locus and site >= start and site < "end"', "o_orderkey:b locus:b site:b start:b end:b tidx:b", POINTS, INTER)
add("union_chunks", "select *, locus % 2 as chunk from inter", I_COLS + " chunk:b", POINTS, INTER)
add("site_to_tree_skewed", """select l_orderkey, l_linenumber, s.locus, site, start, tidx from
  (select l_orderkey, l_linenumber, case when l_orderkey % 3 < 2 then 0 else 1 + l_orderkey % 50 end as locus, l_orderkey * 8 + l_linenumber + l_partkey % 40 as site from lineitem) s
  asof join (select case when o_orderkey % 3 < 2 then 0 else 1 + o_orderkey % 50 end as locus, o_orderkey * 8 as start, o_orderkey * 8 + 5 as "end", o_orderkey as tidx from orders) i on i.locus = s.locus and site >= start
  where site < "end\"""", "l_orderkey:b l_linenumber:b locus:b site:b start:b tidx:b")
add("top_genealogies", "select * from inter order by nbps desc, locus, tidx limit 10", I_COLS, POINTS, INTER)
add("sample_rows", "select * from inter order by md5('sample:' || locus || ':' || tidx), locus, tidx limit 100", I_COLS, POINTS, INTER)
add("phymap", "select row_number() over (order by locus) as chrom, sum(nbps) over (order by locus) - nbps as phy0, sum(nbps) over (order by locus) as phy1, 0 as pos0, nbps as pos1 from (select locus, sum(nbps) as nbps from inter group by 1)", "chrom:b phy0:b phy1:b pos0:b pos1:b", POINTS, INTER)
add("snp_filter", "select candidate, n_mut, n_alleles, row_number() over (order by candidate) - 1 as locus from (select l_orderkey as candidate, count(*) as n_mut, count(distinct l_returnflag) as n_alleles from lineitem group by 1) where n_mut between 2 and 6 and n_alleles >= 2", "candidate:b n_mut:b n_alleles:b locus:b")

Q4 = lambda *k: f"case when {u(*k)} < 0.25 then 0 when {u(*k)} < 0.5 then 1 when {u(*k)} < 0.75 then 2 else 3 end"
add("ancestral_overlay", f"select c.sample, c.locus, c.site, {Q4(chr(39) + 'anc' + chr(39), 'c.locus', 'c.site')} as anc, case when {u(chr(39) + 'mut' + chr(39), 'sample', 'c.site')} < 0.1 then {Q4(chr(39) + 'mutal' + chr(39), 'sample', 'c.site')} else {Q4(chr(39) + 'anc' + chr(39), 'c.locus', 'c.site')} end as allele from calls c", "sample:b locus:b site:b anc:b allele:b", CALLS)
add("site_slice", f"select sample, site, {LETTER('allele')} as base from mcalls where site >= 10 and site < 30", "sample:b site:b base:s", CALLS, MISS)
add("variable_sites", "select locus, site from mcalls group by 1, 2 having count(distinct allele) > 1", "locus:b site:b", CALLS, MISS)
add("contig_lines", "select locus + 1 as chrom, count(*) as length, count(*) filter (v) as nvariable from (select locus, site, count(distinct coalesce(allele, 9)) > 1 as v from mcalls group by 1, 2) group by locus having count(*) filter (v) > 0", "chrom:b length:b nvariable:b", CALLS, MISS)
ALT_S = f"array_to_string(list_transform(alts, lambda x: {LETTER('x')}), ',')"
add("alt_alleles", f"select locus, site, {LETTER('anc')} as ref, {ALT_S} as alt from alta", "locus:b site:b ref:s alt:s", CALLS, MISS, ANC, ALTS, ALTA)
add("geno_index", "select locus, sample, site, gt from geno", "locus:b sample:b site:b gt:b", CALLS, MISS, ANC, ALTS, ALTA, GENO)
add("diploid_map", "select * from dipl", "sample:b pop:b individual:s side:b", CALLS, DIPL)
add("diploid_names", """select sample, pop, case when max(k) over () <= 1 then cast(pop as varchar) else pop || '_' || (k // 2) end as individual, k % 2 as side
  from (select c_nationkey as pop, 'n' || c_nationkey || '_' || c_custkey as sample, row_number() over (partition by c_nationkey order by c_custkey) - 1 as k from customer)""", "sample:s pop:b individual:s side:b")
FULL = (CALLS, MISS, ANC, ALTS, ALTA, GENO, DIPL, SIDES)
add("geno_pairs", f"select locus, site, individual, {GT('l', 'r')} as gt from sides", "locus:b site:b individual:s gt:s", *FULL)
add("geno_fill", f"select locus, site, individual, {GT('coalesce(l, r)', 'coalesce(r, l)')} as gt from sides", "locus:b site:b individual:s gt:s", *FULL)
add("iupac", f"""select locus, site, individual, case when coalesce(l, r) is null then 'N' when coalesce(l, r) = coalesce(r, l) then {LETTER('coalesce(l, r)')}
  else substr('MRWSYK', [1, 2, 3, 4, 5, 6][case least(l, r) * 4 + greatest(l, r) when 1 then 1 when 2 then 2 when 3 then 3 when 6 then 4 when 7 then 5 else 6 end], 1) end as code
  from (select locus, site, individual, max(case when side = 0 then allele end) as l, max(case when side = 1 then allele end) as r from mcalls join dipl using (sample) group by 1, 2, 3)""", "locus:b site:b individual:s code:s", CALLS, MISS, DIPL)
add("vcf_rows", f"""select a.locus + 1 as chrom, a.site + 1 as pos, concat_ws(chr(9), a.locus + 1, a.site + 1, '.', {LETTER('anc')}, {ALT_S}, '99', 'PASS', '.', 'GT', g.gts) as line from alta a
  join (select locus, site, string_agg({GT('coalesce(l, r)', 'coalesce(r, l)')}, chr(9) order by individual) as gts from sides group by 1, 2) g using (locus, site)
  where len(list_filter(alts, lambda x: true)) > 0 and (select count(distinct allele) from mcalls m where m.locus = a.locus and m.site = a.site) > 1""", "chrom:b pos:b line:s", *FULL)
add("snpsmap", "select locus + 1 as locus, row_number() over (partition by locus order by site) - 1 as idx, site + 1 as pos, row_number() over (order by locus, site) as global_idx from (select locus, site from mcalls group by 1, 2 having count(distinct allele) > 1)", "locus:b idx:b pos:b global_idx:b", CALLS, MISS)
add("base_freq", "select pop, allele, count(*) as n from mcalls group by 1, 2", "pop:b allele:b n:b", CALLS, MISS)
add("site_windows", 'select locus, site // 8 as "window", min(site) as start, max(site) + 1 as "end", count(*) filter (v) as nvariable from (select locus, site, count(distinct coalesce(allele, 9)) > 1 as v from mcalls group by 1, 2) group by 1, 2', "locus:b window:b start:b end:b nvariable:b", CALLS, MISS)
C_COLS = "sample:b pop:b locus:b site:b allele:b"
COV = lambda share, *k: f"case when {u(chr(39) + 'cov' + chr(39), *k)} >= {share} then allele end as allele"
add("mask_site", f"select sample, pop, locus, site, {COV('1 - 0.8::double', 'locus', 'sample', 'site')} from calls", C_COLS, CALLS)
add("mask_locus", f"select sample, pop, locus, site, {COV('1 - 0.8::double', 'locus', 'sample')} from calls", C_COLS, CALLS)
add("mask_cutsite", "select m.sample, m.pop, m.locus, m.site, case when not bool_or(m.site % 16 in (0, 15) and allele is distinct from anc) over (partition by m.locus, m.sample) then allele end as allele from cov m join anc using (locus, site)", C_COLS, CALLS, ANC, f"cov as (select sample, pop, locus, site, {COV('1 - 0.9::double', 'locus', 'sample', 'site')} from calls)")
PACK = f"pack as (select locus, sample, string_agg({LETTER('allele')}, '' order by site) as seq from mcalls group by 1, 2)"
add("decode_bases", "select * from pack", "locus:b sample:b seq:s", CALLS, MISS, PACK)
SEQ = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
add("phylip_locus", f"""select doc_id // 10 as locus, count(*) || ' ' || max(length(seq)) || chr(10) || string_agg(rpad(name, cast(greatest(10, length(name)) as integer), ' ') || ' ' || seq, chr(10) order by name) as text
  from (select doc_id, name, rpad(seq, cast(max(length(seq)) over (partition by doc_id // 10) as integer), 'N') as seq from (select doc_id, 's' || doc_id as name, {SEQ} as seq from documents)) group by 1""", "locus:b text:s")
add("phylip_concat", "select rpad('s' || sample, cast(greatest(10, length('s' || sample)) as integer), ' ') || ' ' || string_agg(seq, '' order by locus) as line from pack group by sample", "line:s", CALLS, MISS, PACK)
add("nexus_blocks", f"select block, name, substr(seq, cast(block * 100 + 1 as bigint), 100) as text from (select name, seq, unnest(range(0, cast(ceil(length(seq) / 100.0) as bigint))) as block from (select 's' || doc_id as name, {SEQ} as seq from documents))", "block:b name:s text:s")
add("nexus_concat", "select block, name, substr(seq, cast(block * 10 + 1 as bigint), 10) as text from (select name, seq, unnest(range(0, cast(ceil(length(seq) / 10.0) as bigint))) as block from (select 's' || sample as name, string_agg(seq, '' order by locus) as seq from pack group by sample))", "block:b name:s text:s", CALLS, MISS, PACK)

QUADS = """quads as (select k, locus, site, max(case when pop = 0 then allele end) as s0, max(case when pop = 1 then allele end) as s1, max(case when pop = 2 then allele end) as s2, max(case when pop = 3 then allele end) as s3
  from calls join (select sample, row_number() over (partition by pop order by sample) - 1 as k from (select distinct sample, pop from calls where pop < 4)) using (sample) group by 1, 2, 3 having count(*) = 4)"""
add("site_patterns", "select 4 * s0 + s1 as row, 4 * s2 + s3 as col, count(*) as n from quads group by 1, 2", "row:b col:b n:b", CALLS, QUADS)
KIND = "case when s0 = s3 and s1 = s2 and s0 <> s1 then 'abba' when s0 = s2 and s1 = s3 and s0 <> s1 then 'baba' when s0 = s1 and s1 = s2 and s2 = s3 then 'fixed' else 'other' end"
D = lambda src, by: f"select *, abs(dstat) as abs_dstat from (select *, case when abba + baba > 0 then (abba - baba) / (abba + baba)::double else 0 end as dstat from (select {by}, count(*) filter (kind = 'abba') as abba, count(*) filter (kind = 'baba') as baba, count(*) filter (kind = 'fixed') as fixed, count(*) as nsites from (select *, {KIND} as kind from {src}) group by {by}))"
add("dstat", D("quads", "k"), "k:b abba:b baba:b fixed:b nsites:b dstat:d abs_dstat:d", CALLS, QUADS)
P_JC = lambda a, b, t: f"(case when {a} = {b} then 0.25 + 0.75 * exp(-4 * {t}::double / 3) else 0.25 - 0.25 * exp(-4 * {t}::double / 3) end)"
add("tree_loglik", f"""select k, sum(ln(p)) as loglik from (select k, locus, site, sum(0.25 * {P_JC('r', 'x', 0.05)} * {P_JC('x', 's0', 0.1)} * {P_JC('x', 's1', 0.2)} * {P_JC('r', 's2', 0.3)} * {P_JC('r', 's3', 0.15)}) as p
  from quads, range(4) a(r), range(4) b(x) group by 1, 2, 3) group by 1""", "k:b loglik:d", CALLS, QUADS)
add("pattern_cube", f"select locus, kind, count(*) as n from (select locus, {KIND} as kind from quads) group by cube (locus, kind)", "locus:b kind:s n:b", CALLS, QUADS)
CONS = "cons as (select pop, locus, site, arg_max(allele, n * 4 - allele) as allele from (select pop, locus, site, allele, count(*) as n from mcalls where allele is not null group by 1, 2, 3, 4) group by 1, 2, 3)"
REPS = "reps as (select a.locus, a.site, a.pop as q0, b.pop as q1, c.pop as q2, d.pop as q3, a.allele as s0, b.allele as s1, c.allele as s2, d.allele as s3 from cons a join cons b on a.locus = b.locus and a.site = b.site and a.pop < b.pop join cons c on c.locus = b.locus and c.site = b.site and b.pop < c.pop join cons d on d.locus = c.locus and d.site = c.site and c.pop < d.pop)"
add("quartet_patterns", "select q0, q1, q2, q3, 4 * s0 + s1 as row, 4 * s2 + s3 as col, count(*) as n from reps group by 1, 2, 3, 4, 5, 6", "q0:b q1:b q2:b q3:b row:b col:b n:b", CALLS, MISS, CONS, REPS)
add("dstat_all", D("reps", "q0, q1, q2, q3"), "q0:b q1:b q2:b q3:b abba:b baba:b fixed:b nsites:b dstat:d abs_dstat:d", CALLS, MISS, CONS, REPS)
HAM = "ham as (select a.sample as s0, b.sample as s1, count(*) as nsites, count(*) filter (coalesce(a.allele, 9) <> coalesce(b.allele, 9)) as ndiff from mcalls a join mcalls b on a.site = b.site and a.sample < b.sample group by 1, 2)"
add("pairwise_hamming", "select *, ndiff / nsites::double as dist from ham", "s0:b s1:b nsites:b ndiff:b dist:d", CALLS, MISS, HAM)
add("pairwise_jc", "select s0, s1, case when ndiff / nsites::double < 0.75 then -0.75 * ln(1 - 4.0::double / 3.0 * (ndiff / nsites::double)) end as dist from ham", "s0:b s1:b dist:d", CALLS, MISS, HAM)

SP = "sp as (select * from (values ('A', 'X', 0.0::double, 100.0::double, 1000.0::double), ('B', 'X', 0, 100, 1500), ('C', 'R', 0, 300, 800), ('X', 'R', 100, 300, 1200), ('R', null, 300, null, 2000)) t(node, parent, height, up_height, ne))"
OVER = "ovr as (select * from (values ('A_0', 'A'), ('A_0', 'X'), ('A_0', 'R'), ('A_1', 'A'), ('A_1', 'X'), ('A_1', 'R'), ('B_0', 'B'), ('B_0', 'X'), ('B_0', 'R'), ('C_0', 'C'), ('C_0', 'R')) t(sample, node))"
G = f"""hs as (select tree, h1, h2, greatest(h2, 300) + 1 + 400 * u3 as h3 from (select *, greatest(h1, 100) + 1 + 150 * u2 as h2 from (select c_custkey as tree, 10 + 280 * {u("'gene'", 'c_custkey', '1')} as h1, {u("'gene'", 'c_custkey', '2')} as u2, {u("'gene'", 'c_custkey', '3')} as u3 from customer))),
co as (select tree, case when h1 < 100 then 'A' else 'X' end as node, h1 as height from hs union all select tree, case when h2 < 300 then 'X' else 'R' end, h2 from hs union all select tree, 'R', h3 from hs),
sub as (select * from (values ('A', 'A'), ('B', 'B'), ('C', 'C'), ('X', 'A'), ('X', 'B'), ('X', 'X'), ('R', 'A'), ('R', 'B'), ('R', 'C'), ('R', 'X'), ('R', 'R')) t(node, below)),
ms as (select tree, sp.node, sp.height, up_height, up_height - sp.height as dist, ne as neff, ns.n - coalesce(gone, 0) + coalesce(own, 0) as nedges_in, ns.n - coalesce(gone, 0) as nedges_out, coalesce(own, 0) as ncoals, coalesce(last - sp.height, 0) as waited
  from hs cross join sp join (select node, count(*) as n from ovr group by 1) ns using (node)
  left join (select tree, sub.node, count(*) as gone from co join sub on sub.below = co.node group by 1, 2) g using (tree, node)
  left join (select tree, node, count(*) as own, max(height) as last from co group by 1, 2) o using (tree, node)),
ep as (select tree, node, start, case when nxt is null then up_height else nxt end as stop, neff, nedges_in - i as nedges from (select ms.*, s.start, row_number() over w - 1 as i, lead(s.start) over w as nxt
  from ms join (select tree, node, height as start from ms union all select tree, node, height from co) s using (tree, node) window w as (partition by tree, node order by s.start))),
ge as (select tree, 'A_0' as edge, 'n1' as parent, 0::double as low, h1 as top, 'A' as at from hs union all select tree, 'A_1', 'n1', 0, h1, 'A' from hs union all select tree, 'B_0', 'n2', 0, h2, 'B' from hs union all select tree, 'C_0', 'n3', 0, h3, 'C' from hs
  union all select tree, 'n1', 'n2', h1, h2, 'A' from hs union all select tree, 'n2', 'n3', h2, h3, 'X' from hs),
pa as (select ge.tree, edge, ge.parent, row_number() over (partition by ge.tree, edge order by start) - 1 as i, start, stop, ep.node, neff, nedges, stop - start as dist from ge join sub on sub.below = ge.at join ep on ep.tree = ge.tree and ep.node = sub.node where start >= low - 1e-6 and stop <= top + 1e-6)"""
LK = (SP, OVER, G)
add("embed_msc", "select * from ms", "tree:b node:s dist:d neff:d nedges_in:b nedges_out:b ncoals:b waited:d", *LK)
add("msc_loglik", """select tree, -sum(x) as loss from (
  select tree, (ln(1 / (2 * ne)) - (c.k * (c.k - 1) / 2) * c.wait / (2 * ne)) as x from (select co.tree, co.node, co.height - coalesce(lag(co.height) over w, sp.height) as wait, ms.nedges_in - row_number() over w + 1 as k, ne from co join sp using (node) join ms on ms.tree = co.tree and ms.node = co.node window w as (partition by co.tree, co.node order by co.height)) c
  union all select tree, -(nedges_out * (nedges_out - 1) / 2) * (dist - waited) / (2 * neff) from ms where nedges_out > 1 and dist is not null) group by 1""", "tree:b loss:d", *LK)
add("embed_smc", "select *, stop - start as dist from ep", "tree:b node:s start:d stop:d neff:d nedges:b dist:d", *LK)
add("edge_path", "select * from pa", "tree:b edge:s i:b start:d stop:d node:s neff:d nedges:b dist:d", *LK)
PT = "pt as (select *, coalesce(sum(h) over (partition by tree, edge order by i rows between unbounded preceding and 1 preceding), 0) as c from (select tree, edge, i, start, stop, nedges::double as a, 2 * neff as n, dist as t, nedges * dist / (2 * neff) as h from pa))"
EU = """eu as (select tree, edge, sum(t) as length, sum(t / a + n / a * (1 - exp(-h)) * s) / sum(t) as p from (
  select x.tree, x.edge, x.i, any_value(x.t) as t, any_value(x.a) as a, any_value(x.n) as n, any_value(x.h) as h, sum(case when k.i > x.i then exp(-(k.c - x.c - x.h)) * (1 - exp(-k.h)) / k.a else -1 / x.a end) as s
  from pt x join pt k on k.tree = x.tree and k.edge = x.edge and k.i >= x.i group by 1, 2, 3) group by 1, 2)"""
add("edge_unchanged", "select * from eu", "tree:b edge:s length:d p:d", *LK, PT, EU)
add("edge_unchanged_at", """select x.tree, x.edge, x.time, sum(case when k.i = x.i then (1 - exp(-first)) / x.a else exp(-(first + k.c - (x.c + x.h))) * (1 - exp(-k.h)) / k.a end) as p
  from (select pt.*, time, a * (stop - time) / n as first from pt join (select tree, edge, (min(start) + max(stop)) / 2 as time from pt group by 1, 2) m using (tree, edge) where start <= time and time < stop) x
  join pt k on k.tree = x.tree and k.edge = x.edge and k.i >= x.i group by 1, 2, 3""", "tree:b edge:s time:d p:d", *LK, PT)
TU = "tu as (select tree, sum(length) as sumlen, sum(length * p) / sum(length) as p, 1 / (1e-8 * (1 - sum(length * p) / sum(length)) * sum(length)) as expected from eu group by 1)"
add("tree_unchanged", "select tree, sumlen, p from tu", "tree:b sumlen:d p:d", *LK, PT, EU, TU)
add("expected_dist", "select * from tu", "tree:b sumlen:d p:d expected:d", *LK, PT, EU, TU)
add("distance_lik", "select locus, tidx, nbps, expected, exp(-((nbps - expected) * (nbps - expected)) / (2 * power(expected, 4))) / (expected * expected * sqrt(2 * pi())) * 1e12 as likelihood from inter join tu on tree = locus", "locus:b tidx:b nbps:b expected:d likelihood:d", *LK, PT, EU, TU, POINTS, INTER)
add("smc_compare", "select locus as tree, start, nbps as obs_dist, expected as exp_wait, 1e6 / expected as lambda_, power((nbps - expected) / (expected * expected), 2) / 2 + ln(expected * expected * sqrt(2 * pi())) as logliks from inter join tu on tree = locus", "tree:b start:b obs_dist:b exp_wait:d lambda_:d logliks:d", *LK, PT, EU, TU, POINTS, INTER)
add("node_distances", "select node, tree, expected from tu join (select tree, 'R' as node from hs union all select tree, 'X' from hs) c using (tree)", "node:s tree:b expected:d", *LK, PT, EU, TU)
add("topo_unchanged", """select tree, edge, any_value(length) as length, sum((case when i < m then 1 else 2 end * t + n * (1 - exp(-h)) * b) / a) / any_value(length) as p from (
  select x.tree, x.edge, x.x as i, any_value(x.t) as t, any_value(x.a) as a, any_value(x.n) as n, any_value(x.h) as h, any_value(m) as m, any_value(length) as length,
  sum((case when k.x = x.x then -1 / x.a else exp(-(k.c - x.c - x.h)) * (1 - exp(-k.h)) / k.a end) * (case when x.x < m then 1 + case when k.x >= m and k.x < ib then 1 else 0 end when k.x < ib then 2 else 1 end)) as b
  from mg x join mg k on k.tree = x.tree and k.edge = x.edge and k.x >= x.x join sz on sz.tree = x.tree and sz.edge = x.edge where x.part = 0 group by 1, 2, 3) group by 1, 2""", "tree:b edge:s length:d p:d", *LK,
    """mr as (select tree, edge, parent, 0 as part, i, start, node, nedges::double as a, 2 * neff as n, dist as t, nedges * dist / (2 * neff) as h from pa
  union all select e.tree, e.edge, e.parent, 1, p.i, p.start, p.node, p.nedges, 2 * p.neff, p.dist, p.nedges * p.dist / (2 * p.neff) from (select distinct tree, edge, parent from pa) e join pa p on p.tree = e.tree and p.edge = e.parent
  union all select tree, edge, parent, 1, 0, 'inf'::double, '', 1, 1, 'inf'::double, 'inf'::double from (select distinct tree, edge, parent from pa) where parent = 'n3'),
mg as (select *, row_number() over w - 1 as x, coalesce(sum(h) over (partition by tree, edge order by part, i rows between unbounded preceding and 1 preceding), 0) as c from mr window w as (partition by tree, edge order by part, i)),
sz as (select o.tree, o.edge, count(*) as ib, sum(o.t) as length, coalesce(min(case when s.tree is not null then o.x end), count(*)) as m from mg o left join pa s on s.tree = o.tree and s.parent = o.parent and s.edge <> o.edge and s.node = o.node and s.start = o.start where o.part = 0 group by 1, 2)""")

ORACLES["general_pmat"] = ORACLES["hky_pmat"]
