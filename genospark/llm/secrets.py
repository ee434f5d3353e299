"""Secret scan: candidate strings, judged by a random forest, in DataFrame functions only.

Candidates are all runs of at least `shortest` letters, digits and +/_.~- (with = as padding at the end) that
mix letters with digits or capitals, and runs of at least 6 of any kind behind a key that names a secret, found in the whole text;
words may have any length and hold several.  The key of a run is the name in front of it, if only quotes and = or :, and blanks beside it, lie between.
Features of a candidate: its length, the mean logarithm of its character transitions' probability, the share of changes between
character classes, the share of digits and of capitals, the share of it that dictionary words cover, whether it is hexadecimal, whether
the path looks like tests or samples, and whether a neighbouring word or the key in front names a secret or a placeholder.

The transitions and the dictionary are learned from all words of the documents (`language`): the table of transitions holds the
probabilities of a letter after another in them, and the dictionary their `most` most frequent words of four letters or more.

The forest is grown from labelled findings level by level: one aggregate a level counts the bootstrapped
labels of every tree, node, feature and bin, and the best Gini split of each node is chosen from those counts.  The
trees become one expression, so that scoring stays in generated code.

Edge cases.  Null and empty texts have no candidates.  A null path counts as an ordinary one.  A candidate that a
text holds several times is reported at each place.  Repeated rows are reported each.  Empty tables give an empty
result.  Columns other than the id, the text and the path are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stored

# Words that name secrets, and words that mark placeholders.
SECRET_WORDS = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "credential", "credentials", "auth", "bearer", "private", "access"]
PLACEHOLDER_WORDS = ["example", "sample", "dummy", "placeholder", "changeme", "test", "todo", "xxxx", "your"]

#: Blanks of any script, and line ends.
BLANK = r"[\s\x{85}\p{Z}]"

FEATURES = {
    "length": [12, 14, 16, 18, 20, 21, 24, 32, 40, 48, 64],
    "transitions": [-7.0, -6.0, -5.0, -4.5, -4.0, -3.75, -3.5, -3.25, -3.0, -2.75, -2.5, -2.25],
    "changes": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7],
    "digits": [0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 0.95],
    "capitals": [0.01, 0.1, 0.3, 0.5, 0.7, 0.9],
    "dictionary": [0.01, 0.1, 0.2, 0.3, 0.5, 0.7],
    "hexadecimal": [0.5],
    "path": [0.5],
    "near": [0.5],
    "placeholder": [0.5],
}

#: The states of the transitions: letters, any digit, anything else.
STATES = "abcdefghijklmnopqrstuvwxyz0."
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CLASSES = "a" * 26 + "A" * 26 + "0" * 10


@dataclass(frozen=True)
class Language:
    """What ordinary words look like: the logarithms of transitions (by STATES, row by row), and frequent words."""

    transitions: list[float]
    words: list[str]


def language(docs: DataFrame, most: int = 4000) -> Language:
    """Learned from the words of all texts; at most `most` words and the table of transitions reach the driver."""
    w = F.explode(F.split(F.lower(F.col(docs_text(docs)).cast("string")), r"[^\p{L}]+")).alias("w")
    counts = docs.select(w).where("w rlike '^[a-z]{2,24}$'").groupBy("w").agg(F.count("*").alias("n"))
    counts = stored(counts, "secret-words")
    top = counts.where("length(w) >= 4").orderBy(F.desc("n"), "w").limit(most).collect()
    pairs = counts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    drop(counts)
    n = {r["p"]: r["n"] for r in pairs}
    total = max(1, sum(n.values()))
    table = []
    for a in STATES:
        # a little of every transition, so that none is impossible
        row = [n.get(a + b, 0) + 1e-5 * total / len(STATES) + 0.5 for b in STATES]
        table += [math.log(x / sum(row)) for x in row]
    return Language(table, [r["w"] for r in top])


def candidates(docs: DataFrame, id_col: str = "doc_id", path_col: str = "source", shortest: int = 12) -> DataFrame:
    """id, path, position (of the word), part (number of the piece in the word), before, key, value of every candidate."""
    w = F.split(F.coalesce(F.col(docs_text(docs)).cast("string"), F.lit("")), BLANK)
    rows = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), w.alias("w"))
    names, quotes = "(?i:" + "|".join(SECRET_WORDS) + ")", r"[\\\"']*"
    # cheap tests first: most words are short or plain.  A run may end with two = that don't count here
    loose = lambda x: (F.length(x) >= shortest) & x.rlike("[0-9A-Z]") & x.rlike("[A-Za-z0-9+/_.~-]{%d}" % (shortest - 2))
    keyed = lambda x: (F.length(x) >= 6) & (F.instr(x, "=") + F.instr(x, ":") > 0) & x.rlike(names + quotes + "[=:]")
    word = lambda i, k: F.coalesce(F.get("w", i + k), F.lit(""))
    # a key before blanks: `key: value`, `key = value`, `key =value`
    opened = lambda x, i: (F.length(x) >= 6) & ((x.startswith("=") | x.startswith(":") | word(i, -1).endswith("=") | word(i, -1).endswith(":")) & F.concat_ws(" ", word(i, -2), word(i, -1), F.regexp_extract(x, "^([=:]?)", 1)).rlike(names + quotes + r"\s*[=:]\s*$"))
    odd = F.filter(
        F.transform("w", lambda x, i: F.when(loose(x) | keyed(x) | opened(x, i), F.struct(i.alias("position"), x.alias("word")))),
        lambda x: x.isNotNull(),
    )
    at = lambda k: F.coalesce(F.get("w", F.col("c.position") + k), F.lit(""))
    before = F.concat_ws(" ", F.when(F.col("c.position") >= 2, at(-2)), F.when(F.col("c.position") >= 1, at(-1)))
    # a word is cut into runs and what lies between them
    pieces = F.regexp_extract_all("c.word", F.lit(r"([A-Za-z0-9+/_.~-]+|[^A-Za-z0-9+/_.~-]+)"), 1)
    found = rows.select("id", "path", "w", F.explode(odd).alias("c")).select("id", "path", F.col("c.position").cast("long").alias("position"), before.alias("before"), pieces.alias("x"))
    beside = lambda i: F.coalesce(F.get("x", i), F.lit(""))
    run = lambda x, i: F.when((F.length(x) >= 6) & x.rlike("^[A-Za-z0-9+/_.~-]"), F.struct(i.alias("part"), x.alias("run"), beside(i - 2).alias("name"), beside(i - 1).alias("left"), beside(i + 1).alias("right"), (F.size("x") == i + 2).alias("last")))
    found = found.select("id", "path", "position", "before", F.explode(F.filter(F.transform("x", run), lambda r: r.isNotNull())).alias("r"))
    # the first run of a word may have its key in the words before
    opener = F.when(F.col("r.left").rlike(r"^[=:]?[\\\"']*$") & (F.col("r.part") <= 1), F.concat("before", F.lit(" "), F.regexp_extract("r.left", "^([=:]?)", 1))).otherwise("")
    ahead = F.regexp_extract(opener, r"([A-Za-z_.-]+)" + quotes + r"\s*[=:]\s*$", 1)
    key = F.lower(F.when(F.col("r.left").rlike(r"^\\?[\"']?[=:]") & (F.col("r.name") != ""), F.regexp_extract("r.name", r"([A-Za-z_.-]+)$", 1)).otherwise(ahead))
    # the user of an address begins after the slashes
    bare = F.when(F.col("r.left").endswith(":") & F.col("r.right").rlike("^[@:]"), F.regexp_replace("r.run", "^//", "")).otherwise(F.col("r.run"))
    # = belongs to the run at the word's end, and elsewhere if it fills up a group of four and doesn't lead to a value
    fill = F.regexp_extract("r.right", "^(={1,2})", 1)
    filled = F.col("r.last") | (((F.length(bare) + F.length(fill)) % 4 == 0) & (F.length("r.right") > F.length(fill)))
    # a name that is a key itself is no value
    name = F.col("r.right").rlike(r"^[\\\"']*[=:]") & ~F.col("r.last")
    out = found.select("id", "path", "position", F.col("r.part").cast("long").alias("part"), F.lower("before").alias("before"), key.alias("key"), F.concat(bare, F.when(filled, fill).otherwise("")).alias("value"), name.alias("name"))
    secret = F.col("key").rlike("(" + "|".join(SECRET_WORDS) + ")$") & ~(F.col("name") & F.lower("value").rlike("(" + "|".join(SECRET_WORDS) + ")$"))
    return out.where(secret | ((F.length("value") >= shortest) & F.col("value").rlike("[0-9A-Z]") & F.col("value").rlike("[A-Za-z]"))).drop("name")


def docs_text(docs: DataFrame) -> str:
    return "text" if "text" in docs.columns else "html"


def with_features(found: DataFrame, lang: Language) -> DataFrame:
    """The candidates with one double column `f_<name>` for each feature."""
    v, n = F.col("value"), F.length("value")
    table = F.array(*[F.lit(float(x)) for x in lang.transitions])
    state = lambda i: F.position(F.substring(F.col("__low"), i, F.lit(1)), F.lit(STATES))
    moves = F.aggregate(F.sequence(F.lit(1), F.length("__low") - 1), F.lit(0.0), lambda a, i: a + F.element_at(table, (state(i) - 1) * len(STATES) + state(i + 1)))
    # runs of letters, cut before capitals
    pieces = F.regexp_extract_all(v, F.lit("([A-Z]?[a-z]+|[A-Z]+)"), 1)
    covered = F.aggregate(pieces, F.lit(0), lambda a, x: a + F.when(F.lower(x).isin(lang.words or [""]), F.length(x)).otherwise(0))
    kinds = F.translate(v, LETTERS, CLASSES)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    share = lambda pattern: (n - F.length(F.regexp_replace(v, pattern, ""))) / n
    named = lambda xs: F.when(F.concat_ws(" ", "before", "key").rlike("|".join(xs)), 1.0).otherwise(0.0)
    values = {
        "length": n.cast("double"),
        "transitions": F.when(n > 1, moves / (n - 1)).otherwise(0.0),
        "changes": (runs - 1) / n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "dictionary": covered / n,
        "hexadecimal": F.when(v.rlike("^[0-9a-f]+$"), 1.0).otherwise(0.0),
        "path": F.when(F.lower(F.coalesce("path", F.lit(""))).rlike("test|example|sample|fixture|mock"), 1.0).otherwise(0.0),
        "near": named(SECRET_WORDS),
        "placeholder": F.when((named(PLACEHOLDER_WORDS) > 0) | F.lower(v).rlike("|".join(PLACEHOLDER_WORDS)), 1.0).otherwise(0.0),
    }
    low = F.regexp_replace(F.regexp_replace(F.lower(v), "[0-9]", "0"), "[^a-z0]", ".")
    return found.withColumn("__low", low).withColumns({f"f_{k}": c.cast("double") for k, c in values.items()}).drop("__low")


def labelled_findings(spark: SparkSession, lang: Language, n: int = 6000) -> DataFrame:
    """path, before, key, value, kind, secret: n labelled findings of known kinds, the same each time for a language.

    Secrets: random hexadecimal, base64 and access-key strings behind keys or bare.  False positives: file names, version and
    date strings, capitalised and invented words, addresses, placeholders, repeated characters, checksums without a key.
    """
    r = lambda tag: F.sha2(F.concat(F.lit(tag), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(r("b"))), "[=]+$", "")
    part = lambda c, a, k: F.substring(c, a, k)
    pick = lambda xs, tag: F.element_at(F.array(*[F.lit(x) for x in xs]), F.pmod(F.xxhash64(F.lit(tag), "id"), F.lit(len(xs))).cast("int") + 1)
    syllables = ["the", "an", "tion", "er", "re", "in", "on", "ed", "ment", "le", "que", "ver", "ein", "sch", "de", "los", "ing", "ble"]
    invented = F.concat(*[pick(syllables, f"s{i}") for i in range(5)])
    # half of the words are invented, half are two frequent ones
    common = lang.words[:500] or syllables
    word = F.when(F.pmod(F.xxhash64(F.lit("which"), "id"), F.lit(2)) == 0, invented).otherwise(F.concat(pick(common, "c0"), pick(common, "c2")))
    digits = F.regexp_replace(r("d"), "[a-f]", "")
    kind = F.pmod(F.col("id"), F.lit(20))
    value = (
        F.when(kind == 0, part(r("x"), 1, 40)).when(kind == 1, part(r("x"), 1, 18)).when(kind == 2, b64).when(kind == 3, F.concat(F.lit("AKIA"), F.upper(F.translate(part(b64, 1, 16), "+/", "XY"))))
        .when(kind == 4, part(b64, 1, 24)).when(kind == 5, part(r("x"), 1, 32)).when(kind == 6, part(F.translate(b64, "+/", "__"), 1, 36)).when(kind == 7, part(r("x"), 1, 16))
        .when(kind == 8, F.concat(word, F.lit("."), part(digits, 1, 2), F.lit(".txt"))).when(kind == 9, F.concat(F.lit("v"), part(digits, 1, 1), F.lit("."), part(digits, 2, 2), F.lit("."), part(digits, 4, 2), F.lit("-release")))
        .when(kind == 10, F.initcap(word)).when(kind == 11, F.upper(word)).when(kind == 12, F.concat(word, F.lit("."), part(digits, 1, 2), F.lit("mail.example.com"))).when(kind == 13, F.concat(F.lit("your"), F.initcap(word), F.lit("Here1")))
        .when(kind == 14, F.repeat(part(b64, 1, 1), 20)).when(kind == 15, F.concat(F.lit("xxxxxxxxxxxx"), part(digits, 1, 4))).when(kind == 16, F.concat(F.lit("20"), part(digits, 1, 2), F.lit("-"), part(digits, 3, 2), F.lit("-"), part(digits, 5, 2), F.lit("T"), part(digits, 7, 6), F.lit("Z")))
        .when(kind == 17, F.concat(F.lit("www."), word, part(digits, 1, 1), F.lit(".org/index"))).when(kind == 18, F.concat(pick(syllables, "c1"), F.initcap(word), part(digits, 1, 2))).otherwise(F.concat(F.lit("example"), part(r("x"), 1, 20)))
    )
    keyed = kind.isin(0, 1, 5, 7) | (kind.isin(2, 4, 6) & (F.pmod(F.xxhash64("id"), F.lit(3)) > 0))
    key = F.when(keyed, pick(["token", "password", "secret", "api_key", "auth_token"], "k")).when(kind == 13, F.lit("password")).when(kind == 14, pick(["", "token"], "k")).when(kind == 19, F.lit("token")).otherwise("")
    before = F.concat_ws(" ", pick(syllables, "w1"), pick(syllables, "w2"))
    path = pick(["src1", "src2", "repo/main.py", "docs/readme", "repo/tests/data", "samples/a"], "p")
    rows = spark.range(n, numPartitions=4).select("id", path.alias("path"), before.alias("before"), key.alias("key"), value.alias("value"), kind.alias("kind"), (kind < 8).cast("int").alias("secret"))
    return rows


def _binned(rows: DataFrame) -> DataFrame:
    """b_<name>: how many of a feature's thresholds lie at or below its value."""
    return rows.withColumns({f"b_{k}": sum(F.when(F.col(f"f_{k}") >= t, 1).otherwise(0) for t in cuts) for k, cuts in FEATURES.items()})


def _leaf(tree: dict, node: int, inner, leaf) -> Column:
    """A tree as nested conditions; inner(feature, bin) is true for the right child."""
    if node not in tree["splits"]:
        return leaf(node)
    name, b = tree["splits"][node]
    return F.when(inner(name, b), _leaf(tree, 2 * node + 1, inner, leaf)).otherwise(_leaf(tree, 2 * node, inner, leaf))


def grow(findings: DataFrame, lang: Language, trees: int = 12, depth: int = 5, tried: int = 5, least: int = 4) -> list[dict]:
    """A forest from labelled findings (path, before, key, value, secret).

    `tried` features, chosen by a hash, compete at each node.  Counts come from one aggregate a level.
    """
    rows = _binned(with_features(findings, lang)).select("secret", F.xxhash64("path", "before", "key", "value").alias("h"), *[f"b_{k}" for k in FEATURES]).cache()
    forest = [{"splits": {}, "leaves": {}} for _ in range(trees)]
    u = F.pmod(F.xxhash64("h", "tree"), F.lit(1 << 20)) / float(1 << 20)
    # Poisson(1) bootstrap weights
    weight = F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).when(u < 0.981, 3).otherwise(4)
    names = list(FEATURES)
    for level in range(depth + 1):
        node = F.lit(-1)
        for t, tree in enumerate(forest):
            node = F.when(F.col("tree") == t, _leaf(tree, 1, lambda k, b: F.col(f"b_{k}") >= b, lambda i: F.lit(i))).otherwise(node)
        each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumns({"w": weight, "node": node}).where(f"w > 0 and node >= {1 << level}")
        bins = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b_{k}").alias("b")) for i, k in enumerate(names)])).alias("x")
        # trees x nodes x features x bins rows
        got = each.select("tree", "node", "secret", "w", bins).groupBy("tree", "node", "x.f", "x.b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("secret")).alias("p")).collect()
        counts: dict = defaultdict(lambda: defaultdict(dict))
        for r in got:
            counts[r["tree"], r["node"]][r["f"]][r["b"]] = (r["n"], r["p"])
        for (t, i), by in counts.items():
            n, p = (sum(x[j] for x in by[0].values()) for j in (0, 1))
            forest[t]["leaves"][i] = (p + 0.5) / (n + 1)
            if level == depth or n < 2 * least or p in (0, n):
                continue
            best = None
            for f in sorted(range(len(names)), key=lambda f: hash((t * 7919 + i) * 104729 + f * 1299709) % 1000003)[:tried]:
                for cut in range(1, len(FEATURES[names[f]]) + 1):
                    rn, rp = (sum(x[j] for b, x in by[f].items() if b >= cut) for j in (0, 1))
                    ln, lp = n - rn, p - rp
                    if min(rn, ln) >= least:
                        gini = rp * (rn - rp) / rn + lp * (ln - lp) / ln
                        if best is None or gini < best[0]:
                            best = (gini, names[f], cut)
            if best and best[0] < p * (n - p) / n - 1e-9:
                forest[t]["splits"][i] = best[1:]
    rows.unpersist()
    return forest


def forest_score(forest: list[dict]) -> Column:
    """The mean of the trees' leaves, from the columns f_<name>."""
    trees = [_leaf(t, 1, lambda k, b: F.col(f"f_{k}") >= FEATURES[k][b - 1], lambda i, t=t: F.lit(float(t["leaves"].get(i, 0.5)))) for t in forest]
    return sum(trees[1:], trees[0]) / float(len(trees))


def findings(docs: DataFrame, forest: list[dict], lang: Language, id_col: str = "doc_id", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """id_col, position, part, key, value_sha256, shown (a masked form), length, score, is_secret of every candidate."""
    found = with_features(candidates(docs, id_col, path_col), lang).withColumn("score", F.round(forest_score(forest), 6))
    return found.select(
        F.col("id").alias(id_col), "position", "part", "key", F.sha2("value", 256).alias("value_sha256"), F.concat(F.substring("value", 1, 4), F.lit("…")).alias("shown"),
        F.length("value").alias("length"), "score", (F.col("score") >= threshold).cast("int").alias("is_secret"),
    )
