"""Sinks: phylip, nexus, VCF, population files, index maps.  Text is built in Spark; writers only store it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bases
from ..operators import calls as C
from ..operators.numbering import numbered


def pack(calls: DataFrame) -> DataFrame:
    """locus, sample, seq: letters of a sample's calls in site order."""
    letters = F.transform(F.sort_array(F.collect_list(F.struct("site", bases.base(F.col("allele")).alias("b")))), lambda x: x["b"])
    return calls.groupBy("locus", "sample").agg(F.array_join(letters, "").alias("seq"))


def pack_codes(codes: DataFrame) -> DataFrame:
    """locus, individual, seq: diploid letters in site order.  codes: locus, site, individual, code."""
    letters = F.transform(F.sort_array(F.collect_list(F.struct("site", "code"))), lambda x: x["code"])
    return codes.groupBy("locus", "individual").agg(F.array_join(letters, "").alias("seq"))


def unpack(seqs: DataFrame) -> DataFrame:
    """locus, sample, site, allele from packed sequences; letters other than ACGT are missing."""
    long = seqs.select("locus", "sample", F.posexplode(F.split("seq", "")).alias("site", "b"))
    code = None
    for i, letter in enumerate(bases.BASES):
        code = F.when(F.col("b") == letter, i) if code is None else code.when(F.col("b") == letter, i)
    return long.select("locus", "sample", F.col("site").cast("long").alias("site"), code.alias("allele"))


def _lines(name: Column, text: Column) -> Column:
    """Lines joined in the order of the names."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(name.alias("n"), text.alias("t")))), lambda x: x["t"]), "\n")


def padded(name: Column, width: int = 10) -> Column:
    """A name padded to a width, never cut."""
    return F.rpad(name, F.greatest(F.length(name), F.lit(width)), F.lit(" "))


def aligned(seqs: DataFrame, fill: str = "N") -> DataFrame:
    """Sequences filled up to the longest of their locus."""
    longest = seqs.groupBy("locus").agg(F.max(F.length("seq")).alias("__longest"))
    return seqs.join(longest, "locus").withColumn("seq", F.rpad("seq", F.col("__longest"), F.lit(fill))).drop("__longest")


def phylip(seqs: DataFrame) -> DataFrame:
    """locus, text: one phylip document a locus.  seqs: locus, name, seq."""
    line = F.concat(padded(F.col("name")), F.lit(" "), F.col("seq"))
    head = F.concat_ws(" ", F.count("*").cast("string"), F.max(F.length("seq")).cast("string"))
    return seqs.groupBy("locus").agg(F.concat(head, F.lit("\n"), _lines(F.col("name"), line)).alias("text"))


def concatenated(seqs: DataFrame) -> DataFrame:
    """name, seq: all loci of a sample side by side, in locus order."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("locus", "seq"))), lambda x: x["seq"]), "")
    return seqs.groupBy("name").agg(whole.alias("seq"))


def nexus_blocks(seqs: DataFrame, width: int = 100) -> DataFrame:
    """block, name, text: interleaved pieces of `width` characters.  seqs: name, seq."""
    n = F.ceil(F.length("seq") / width).cast("int")
    cut = seqs.where("length(seq) > 0").withColumn("block", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select("block", "name", F.substring("seq", F.col("block") * width + 1, F.lit(width)).alias("text"))


def nexus_cut(seqs: DataFrame, width: int = 100) -> DataFrame:
    """block, name, text: as nexus_blocks of the concatenated loci, without putting a sample's loci into one string.

    A locus starts at the sum of the lengths before it; its letters fall into blocks by their places.  seqs: locus, name, seq.
    """
    sizes = seqs.groupBy("locus").agg(F.max(F.length("seq")).alias("size"))
    placed = seqs.where("length(seq) > 0").join(numbered(sizes, "locus", "before", size="size"), "locus")
    first, last = F.floor(F.col("before") / width), F.floor((F.col("before") + F.length("seq") - 1) / width)
    parts = placed.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.lit(0), F.col("block") * width - F.col("before"))
    stop = F.least(F.length("seq"), (F.col("block") + 1) * width - F.col("before"))
    piece = F.substring("seq", (start + 1).cast("int"), (stop - start).cast("int"))
    return _joined_by(parts.select("block", "name", "locus", piece.alias("text")), ["block", "name"])


def _joined_by(parts: DataFrame, by: list[str]) -> DataFrame:
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("locus", "text"))), lambda x: x["text"]), "")
    return parts.groupBy(*by).agg(whole.alias("text"))


def nexus_header(ntax: int, nchar: int) -> str:
    return f"#NEXUS\nbegin data;\n  dimensions ntax={ntax} nchar={nchar};\n  format datatype=DNA missing=N gap=- interleave=yes;\n  matrix"


def nexus_lines(seqs: DataFrame, width: int = 100) -> DataFrame:
    """part, block, name, value: a nexus document in the order of the first three columns.  seqs: locus, name, seq of concatenated loci."""
    spark = seqs.sparkSession
    sizes = seqs.groupBy("name").agg(F.sum(F.length("seq")).alias("n")).agg(F.count("*").alias("ntax"), F.max("n").alias("nchar")).first()
    edge = spark.createDataFrame([(0, -1, "", nexus_header(sizes["ntax"], sizes["nchar"] or 0)), (2, -1, "", "  ;\nend;")], "part int, block long, name string, value string")
    body = nexus_cut(seqs, width).select(F.lit(1).alias("part"), "block", "name", F.concat(F.lit("  "), padded(F.col("name")), F.lit(" "), F.col("text")).alias("value"))
    return edge.unionByName(body)


def vcf_rows(calls: DataFrame, anc: DataFrame, pairs: DataFrame | None = None, fill: bool = True) -> DataFrame:
    """chrom, pos, line: a VCF row of every variable site; sample columns are in the order of their names.

    Without pairs every haploid is written as an individual of two equal sides.
    """
    if pairs is None:
        pairs = calls.select("sample", "pop").distinct().select("sample", F.col("sample").alias("individual"), F.lit(0).alias("side"))
    genos = C.geno_index(calls, anc)
    sides = C.geno_pairs(genos, pairs, fill)
    gt = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("individual", bases.genotype(F.col("left"), F.col("right")).alias("g")))), lambda x: x["g"]), "\t")
    columns = sides.groupBy("locus", "site").agg(gt.alias("gts"))
    sites = C.alt_alleles(calls, anc).join(C.variable_sites(calls), C.SITE, "left_semi")
    chrom, pos = F.col("locus") + 1, F.col("site") + 1
    line = F.concat_ws("\t", chrom.cast("string"), pos.cast("string"), F.lit("."), bases.base(F.col("anc")), C.alt_string(), F.lit("99"), F.lit("PASS"), F.lit("."), F.lit("GT"), "gts")
    return sites.join(columns, C.SITE).select(chrom.alias("chrom"), pos.alias("pos"), line.alias("line"))


def vcf_header(samples: list[str]) -> tuple[str, str]:
    """What stands before and after the contig lines of a header."""
    head = ["##fileformat=VCFv4.2", "##source=genospark", "##reference=ancestral states of the loci"]
    tail = ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    return "\n".join(head), "\n".join(tail)


def vcf_lines(calls: DataFrame, anc: DataFrame, pairs: DataFrame | None = None, fill: bool = True) -> DataFrame:
    """chrom, pos, line: a VCF document in the order of chrom and pos; its header are the lines of chrom 0.

    The loci that vary have a line each, whose pos is their chrom.  The sample names, as many as a row has columns, go through the driver.
    """
    people = calls.select(F.col("sample").cast("string").alias("n")) if pairs is None else pairs.select(F.col("individual").cast("string").alias("n"))
    head, tail = vcf_header(sorted(r["n"] for r in people.distinct().collect()))
    edges = calls.sparkSession.createDataFrame([(0, 0, head), (0, (1 << 62), tail)], "chrom long, pos long, line string")
    contig = F.concat(F.lit("##contig=<ID="), F.col("chrom").cast("string"), F.lit(",length="), F.col("length").cast("string"), F.lit(">"))
    contigs = C.contig_lines(calls).select(F.lit(0).cast("long").alias("chrom"), F.col("chrom").cast("long").alias("pos"), contig.alias("line"))
    return edges.unionByName(contigs).unionByName(vcf_rows(calls, anc, pairs, fill).select(F.col("chrom").cast("long").alias("chrom"), F.col("pos").cast("long").alias("pos"), "line"))


def phymap(summary: DataFrame) -> DataFrame:
    """chrom (from 1), phy0, phy1, pos0, pos1: offsets of loci placed side by side."""
    end = F.col("before") + F.col("nbps")
    rows = numbered(numbered(summary, "locus", "chrom"), "locus", "before", size="nbps")
    return rows.select((F.col("chrom") + 1).cast("long").alias("chrom"), F.col("before").alias("phy0"), end.alias("phy1"), F.lit(0).cast("long").alias("pos0"), F.col("nbps").alias("pos1"))


def snpsmap(sites: DataFrame) -> DataFrame:
    """locus (from 1), idx (in the locus), pos (from 1), global idx (from 1) of variable sites.

    Loci are numbered by their totals before sites are: no task sorts all sites.
    """
    per = sites.groupBy("locus").agg(F.count("*").alias("n"))
    before = numbered(per, "locus", "before", size="n").select("locus", "before")
    idx = F.row_number().over(W.partitionBy("locus").orderBy("site")) - 1
    return sites.withColumn("idx", idx.cast("long")).join(before, "locus").select((F.col("locus") + 1).alias("locus"), "idx", (F.col("site") + 1).alias("pos"), (F.col("before") + F.col("idx") + 1).alias("global_idx"))


def popfile(samples: DataFrame) -> DataFrame:
    """value: `pop<TAB>sample` lines; the population is the name up to its first underscore."""
    return samples.select(F.concat_ws("\t", F.split_part("name", F.lit("_"), F.lit(1)), "name").alias("value"))


def imap(samples: DataFrame) -> DataFrame:
    """pop, line `pop: a,b,c`."""
    pop = F.split_part("name", F.lit("_"), F.lit(1))
    return samples.groupBy(pop.alias("pop")).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names")).select("pop", F.concat(F.col("pop"), F.lit(": "), F.col("names")).alias("line"))


def fasta(seqs: DataFrame) -> DataFrame:
    return seqs.select("locus", F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value"))


def write_text(lines: DataFrame, path: str, by: str | None = None, codec: str | None = None) -> None:
    """Store one text column, in a folder a value of `by`."""
    out = lines.write.option("compression", codec) if codec else lines.write
    (out.partitionBy(by) if by else out).text(path)
