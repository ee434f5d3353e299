"""Token files: codes, round trips of whole tables and odd texts, and reading from the middle."""

import heapq
import json
import random
import zlib

import numpy as np
import pyarrow.fs
import pytest

from genospark.llm import common, token_output
from genospark.llm.queries import QUERIES, TOKENIZER

DOCS = "doc_id long, text string, ids string, start string, counts int"
MULTI = "/opt/tokenizers/word_bpe_49k.json"


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def in_order(rows, encode, end):
    """doc_id, n_tokens, ids of rows by id; rows of one id may stand in any order."""
    return sorted(((i is not None, i or 0, (*encode(t), *end)) for i, t in rows))


def check(got, rows, encode, end=(2,)):
    got = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0, tuple(np.frombuffer(r["ids"], dtype="<u4").tolist())) for r in got]
    assert [x[:2] for x in ids] == sorted(x[:2] for x in ids)
    assert sorted(ids) == in_order(rows, encode, end)


@pytest.mark.parametrize("seed", range(10))
def test_codes(seed):
    r = random.Random(seed)
    for _ in range(30):
        counts = np.array([r.choice([0, 1, 2, 5, 50, 1000, 10**12]) for _ in range(r.randint(1, 60))])
        used = counts > 0
        for limit in (6, 7, 18):
            lengths = token_output.code_lengths(counts, limit)
            assert (lengths[used] > 0).all() and not lengths[~used].any() and lengths.max(initial=0) <= limit
            if used.sum() > 1:
                assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
        if used.sum() > 1:  # without a limit that matters it is a Huffman code's length
            h, total = sorted(counts[used].tolist()), 0
            while len(h) > 1:
                s = heapq.heappop(h) + heapq.heappop(h)
                total += s
                heapq.heappush(h, s)
            assert int((token_output.code_lengths(counts, 60).astype(int) * counts).sum()) == total


@pytest.mark.parametrize("limit", [3, 4, 5])
def test_limited_codes_are_shortest(limit):
    """Against every sequence of lengths that fills the code space."""
    r = random.Random(limit)
    for _ in range(10):
        counts = sorted((r.choice([1, 2, 3, 8, 40, 300]) for _ in range(6)), reverse=True)

        def best(k, room, least):
            if k == len(counts):
                return 0
            return min((counts[k] * n + best(k + 1, room - 2 ** (limit - n), n) for n in range(least, limit + 1) if room >= 2 ** (limit - n)), default=10**9)

        assert int((token_output.code_lengths(np.array(counts), limit).astype(int) * counts).sum()) == best(0, 2**limit, 1)


def test_canonical():
    code = token_output.Code(np.array([2, 0, 1, 3, 3]))
    assert code.codes.tolist() == [0b10, 0, 0b0, 0b110, 0b111]


@pytest.mark.parametrize("every", [1, 7, 512])
def test_blocks_from_the_middle(every):
    r = random.Random(every)
    for _ in range(20):
        lengths = token_output.code_lengths(np.array([1, 5, 0, 90, 2000, 3, 3]), 18)
        code = token_output.Code(lengths)
        ids = np.array(r.choices([0, 1, 3, 4, 5, 6], k=r.randint(0, 900)), dtype="<u4")
        cut = r.randint(0, len(ids))
        block = token_output.Block.read(token_output.Block.of(code, [(None, ids[:cut].tobytes()), (4, ids[cut:].tobytes())], every).write())
        assert (block.ids(code) == ids).all() and block.sizes.tolist() == [cut, len(ids) - cut]
        i = r.randint(0, len(ids))
        j = r.randint(i, len(ids))
        assert (block.ids(code, i, j) == ids[i:j]).all()
    raw = bytearray(token_output.Block.of(code, [(1, ids.tobytes())], every).write())
    raw[-1] ^= 1
    with pytest.raises(ValueError):
        token_output.Block.read(bytes(raw))


@pytest.mark.parametrize("pool", ["ab 1 \n\t\r\x0b\x0c\x1c\x85\xa0 '!.,é東😀²×sst'll've", "ab  1\n\t\x0b'!.,éß st'll've'd", " \n", "'s ' aé"])
def test_cuts_are_exact(pool):
    enc, r = token_output.Encoder(TOKENIZER, most=2000), random.Random(len(pool))
    texts = ["".join(r.choices(pool, k=r.randint(0, 25))) for _ in range(4000)] + ["'" * 40, "a" * 40 + "'s", "   a", "<|endoftext|>"]
    encode = library(TOKENIZER)
    for k in range(0, len(texts), 500):
        got = enc.encode(texts[k : k + 500])
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [encode(t) for t in texts[k : k + 500]]


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 200_000 + "a", "\n" * 200_000, "ab " * 200_000, "é" * 100_000 + "東"])
def test_long_texts(text):
    (got,) = token_output.Encoder(TOKENIZER).encode([text])
    assert np.frombuffer(got, dtype="<u4").tolist() == library(TOKENIZER)(text)


def test_known_pieces_are_not_taken_up_again(monkeypatch):
    """Short pieces that were met before are found for a batch at once; before, each batch took up all its distinct pieces one by one."""
    r = random.Random(1)
    texts = [" ".join("".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(300)) + ".\n" for _ in range(40)]
    enc, taken, ids = token_output.Encoder(TOKENIZER), [], token_output.Encoder._ids
    first = enc.encode(texts)
    monkeypatch.setattr(token_output.Encoder, "_ids", lambda self, kind, pieces: taken.extend(pieces) or ids(self, kind, pieces))
    assert enc.encode(texts) == first
    assert len(taken) < 100


@pytest.mark.parametrize("most", [1, 30, 100_000])
def test_pieces_that_replace_each_other(most):
    """Few slots for many pieces, of sizes around those that fit into two numbers."""
    enc, r, encode = token_output.Encoder(TOKENIZER, most=most), random.Random(most), library(TOKENIZER)
    words = ["".join(r.choices("abstéß", k=r.randint(1, 20))) for _ in range(150)]
    for _ in range(30):
        texts = ["".join(r.choice(words) + r.choice([" ", " ", ", ", "\n", "'", "'s ", "  ", "." * 14 + " ", "-" * 16]) for _ in range(r.randint(0, 60))) for _ in range(8)] + ["", " "]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in enc.encode(texts)] == [encode(t) for t in texts]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got, at, encode = {r["doc_id"]: r for r in QUERIES["op13_token_output"](spark, sf).collect()}, 0, library(TOKENIZER)
    assert len(got) == len(rows)
    for i, t in sorted(rows):
        ids = np.array([*encode(t), 2], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("tokenizer", [TOKENIZER, MULTI])
def test_odd(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate([None, "", " \n\t ", "a", "naïve café 東京", "same", "same", "\x00\x01", "'\" ; -- \\", "x " * 4000])]
    rows += [(5, "same"), (5, "other"), (None, "no id"), (None, "no id"), (None, None), (-7, "below")] + [(9, "copy of copies")] * 40
    docs = spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in rows], DOCS).repartition(3)
    back = token_output.round_trip(docs, tokenizer, 2, block_ids=500, every=16, part_ids=1500)
    check(back.collect(), rows, library(tokenizer))
    assert back.columns == ["doc_id", "start", "n_tokens", "ids"]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_output.round_trip(docs, TOKENIZER, 2).count() == 0
    only = spark.createDataFrame([(3, None), (1, "")], "doc_id long, text string")
    check(token_output.round_trip(only, TOKENIZER, 2).collect(), [(3, None), (1, "")], library(TOKENIZER))


def test_only_files_of_the_manifest_count(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    rows = [(i, f"text number {i}") for i in range(300)]
    token_output.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), TOKENIZER, path, 2, part_ids=400, block_ids=100)
    store, folder = pyarrow.fs.FileSystem.from_uri(path)
    listed = json.loads(store.open_input_stream(f"{folder}/manifest.json").read())["files"]
    assert len(listed) > 2 and [x["start"] for x in listed] == np.cumsum([0, *(x["n_ids"] for x in listed[:-1])]).tolist()
    # a file of a task that was lost
    store.copy_file(f"{folder}/{listed[0]['file']}", f"{folder}/lost.tokens")
    check(token_output.read(spark, path).collect(), rows, library(TOKENIZER))


def test_scratch_is_in_the_shared_folder(spark):
    assert common.scratch(spark, "x").startswith(common.shared_dir(spark))
