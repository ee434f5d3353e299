"""Block-gzip files: round trips over any split, blocks as the format has them, and VCF documents read back."""

import gzip
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from genospark.sources import bgzf


def document(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("abc\t é東", k=r.choice([0, 1, 30, 30, 30, 70_000 if r.random() < 0.02 else 200]))) for _ in range(n)]


def packed(lines):
    raw = "".join(f"{x}\n" for x in lines).encode()
    return b"".join(bgzf.block(raw[k : k + bgzf.MOST]) for k in range(0, len(raw), bgzf.MOST)) + bgzf.block(b"")


def test_blocks_are_of_the_format():
    assert bgzf.block(b"").hex() == "1f8b08040000000000ff0600424302001b0003000000000000000000"
    noise = random.Random(1).randbytes(bgzf.MOST)
    for data in (b"x", b"a" * bgzf.MOST, noise):
        raw = bgzf.block(data)
        assert len(raw) <= 1 << 16 and bgzf.size_at(raw, 0) == len(raw) and gzip.decompress(raw) == data == bgzf.unpacked(raw)
    broken = bytearray(bgzf.block(noise))
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        bgzf.unpacked(bytes(broken))


class Opened(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("split", [1, 37, 1000, 30_000, 65_536, 1 << 22])
@pytest.mark.parametrize("seed", range(3))
def test_any_split_gives_each_line_once(seed, split):
    lines = document(seed, 400) + (["no newline behind"] if seed else [])
    raw = packed(lines)
    f = Opened(raw)
    if split < 900:
        raw = packed(lines := lines[:12])
        f = Opened(raw)
    got = [x.decode() for at in range(0, len(raw), split) for x in bgzf.lines_of(f, at, at + split)]
    assert got == lines


def test_round_trip(spark, tmp_path):
    lines = document(5, 3000)
    df = spark.createDataFrame(list(enumerate(lines)), "id long, value string").repartitionByRange(4, "id").sortWithinPartitions("id").select("value")
    path = f"file://{tmp_path}/out"
    bgzf.write_lines(df, path)
    names = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert len(names) == 4 and "".join(gzip.decompress((tmp_path / "out" / n).read_bytes()).decode() for n in names) == "".join(f"{x}\n" for x in lines)
    for split in (20_000, 8 << 20):
        got = bgzf.read_lines(spark, path, split)
        assert sorted(r["value"] for r in got.collect()) == sorted(lines)
    one = bgzf.read_lines(spark, f"file://{tmp_path}/out/{names[1]}", 5000)
    assert one.count() == len(gzip.decompress((tmp_path / "out" / names[1]).read_bytes()).split(b"\n")) - 1


def test_vcf(spark, tmp_path):
    from genospark.model import Model

    m = Model(spark, "((a:1000,b:1000):1000,c:2000);", Ne=1000, nsamples=2, mut=1e-6, recomb=0, seed_trees=3)
    loci = m.sim_loci(nloci=3, nsites=200)
    path = f"file://{tmp_path}/vcf"
    loci.write_vcf(path, bgzip=True)
    rows = bgzf.read_vcf(spark, path)
    got = {(r["chrom"], r["pos"], r["individual"]): (r["ref"], r["gt"]) for r in rows.collect()}
    calls, anc = loci.calls, loci.ancestral
    varied = calls.groupBy("locus", "site").agg(F.countDistinct("allele").alias("n")).where("n > 1")
    want = calls.join(anc, ["locus", "site"]).join(varied, ["locus", "site"]).collect()
    assert len(got) == len(want) > 0
    for r in want:
        ref, gt = got[r["locus"] + 1, r["site"] + 1, r["sample"]]
        assert ref == "ACGT"[r["anc"]] and (gt == "0|0") == (r["allele"] == r["anc"])
    lines = [r["value"] for r in bgzf.read_lines(spark, path).collect()]
    assert lines[0] == "##fileformat=VCFv4.2" and sum(x.startswith("#CHROM") for x in lines) == 1
