"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: The hash tree with its draws, the checksum (the polynomial of CRC-32, reflected, is a fixed value), and slots in order.
SHARDING = """with tab as (select list(c order by n) as tab from (select n, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n) as c from range(256) t(n))),
d as (select doc_id, coalesce(text, '') as tx, hex(encode(coalesce(text, ''))) as hx, coalesce(cast(doc_id as varchar), chr(0) || 'null') as k from documents),
b as (select doc_id, k, octet_length(encode(tx)) + 8 as size, xor(list_reduce(list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::bigint), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) as text_crc32 from d, tab),
keys as (select distinct k from b),
draw as (select k, name, -ln((cast(('0x' || substr(md5(k || '|' || name), 1, 12))::UBIGINT as double) + 0.5) / 281474976710656.0) as e from keys,
  (select 'g' || g as name from range(4) t(g) union all select 'g' || (r // 2) || 'r' || (r % 2) from range(6) t(r) union all select 's' || s from range(24) t(s)) n),
reg as (select k, arg_min(cast(substr(name, 2) as int), e / 8) filter (name <> 'g3') as g, min(e / 8) filter (name <> 'g3') > min(e) filter (name = 'g3') as grows from draw where name in ('g0', 'g1', 'g2', 'g3') group by k),
rack as (select k, g, grows, arg_min(cast(substr(name, 4) as int), e) as r from reg join draw using (k) where name in ('g' || g || 'r0', 'g' || g || 'r1') group by k, g, grows),
leaf as (select k, grows, arg_min(s, e) as shard from (select k, g, r, grows, cast(substr(name, 2) as int) as s, e from rack join draw using (k) where name like 's%') x where s // 8 = g and s % 8 // 4 = r group by k, grows)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'key' as law, cast(shard as integer) as shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot, cast(case when grows then 24 else shard end as integer) as grown_shard from b join leaf using (k)"""

ORACLES: dict[str, str] = {"op2_sharding": SHARDING}
