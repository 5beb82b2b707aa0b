"""Secret scan: candidates by pattern, false positives removed by a random forest.

DataFrame functions only. A text is split at its candidates inside its row; the
parts between them give the context. The forest is trained on labelled findings
made from the templates below, over candidate length, character transitions,
dictionary coverage, path and neighbouring words. Its trees become one column
expression, so whole tables are scored in the scan, without a shuffle.

Texts are split once per row: a generator keeps filters and lambdas from repeating the split.

Defined results: null and empty texts have no findings, an empty table has none.
Null ids and repeated rows are scanned like any other row; equal secrets of a text
are found each. Very long texts are scanned whole, in time that grows with their
length. Other columns, also those named like inner ones, pass through ``redacted``
unchanged; ``n_chars``, if there, becomes the length of the redacted text.
"""

from __future__ import annotations

import random
import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import quoted, set_aside
from ledgerloom.operators.settle import settle

#: Quoted values up to the closing quote behind ``=`` or ``:``, long runs of key characters, and
#: other values of at least eight characters behind ``=`` or ``:``.
CANDIDATE = (
    r"(?<=[=:] ?\")[^\s\"\x01\x02]{8,}(?=\")|(?<=[=:] ?')[^\s'\x01\x02]{8,}(?=')"
    r"|[A-Za-z0-9_+/=-]{16,}|(?<=[=:][ \"']{0,2})[^\s\"'=:,;<>(){}\[\]|*#&\x01\x02]{8,}"
)
#: Stands around candidates; one in the text itself is told by ``_KEPT`` behind it.
_SPLIT, _KEPT = "\u0001", "\u0002"
_BEFORE, _AFTER = 48, 24
_SECRET_WORDS = "token|secret|passw|passphrase|pwd|api.?key|apikey|access.?key|private.?key|auth|bearer|credential|signing"
_HARMLESS_WORDS = (
    "sha|md5|checksum|digest|commit|revision|hash|uuid|guid|etag|build|version|example|sample|dummy|placeholder|test|"
    "order|invoice|card|account|phone|fingerprint|integrity|isbn"
)
#: Words that names, paths and placeholders are made of.
DICTIONARY = (
    "about account action admin after agent application array assets author backup base batch before between branch "
    "build button cache change check class client cloud code column common config content context control cookie count "
    "country create customer daily data database date default delete design details development directory document "
    "download drive email engine error event example export field file filter folder format forward frame function "
    "general global group handler header health history home html http image import index info input insert install "
    "internal invoice item java kernel language layer layout level library license list local login machine main "
    "manager market master match memory message method model module month name network node note number object office "
    "online open option order other output package page parent parser password path payment people phone picture place "
    "player plugin point policy price private process product profile program project property public query question "
    "random record reference region release remote report request resource response result return review route sample "
    "schema school script search second secret section security select server service session setting share simple "
    "single source space standard start state static status storage store stream string student style submit support "
    "switch system table target task template test text theme thing thread time title token tool total track traffic "
    "training transaction transfer type under unit update upload user value version video view visit water web website "
    "week window word work world write year your here the and for with this that from have will are not you insert"
).split()

FEATURES = [
    "length",
    "transitions",
    "variety",
    "digits",
    "uppers",
    "hex",
    "known_prefix",
    "dictionary",
    "path",
    "secret_word",
    "harmless_word",
    "assigned",
]


def parts(text: Column) -> Column:
    """The text split at its candidates, which stand at the odd places counted from zero."""
    marked = F.regexp_replace(F.replace(text, F.lit(_SPLIT), F.lit(_SPLIT + _KEPT)), CANDIDATE, f"{_SPLIT}$0{_SPLIT}")
    split = F.split(marked, f"{_SPLIT}(?!{_KEPT})")
    restored = F.transform(split, lambda p: F.replace(p, F.lit(_SPLIT + _KEPT), F.lit(_SPLIT)))
    return F.when(text.contains(_SPLIT), restored).otherwise(split)


def _share(text: Column, characters: str, length: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]", "")) / length


def features(candidate: Column, before: Column, after: Column) -> Column:
    """The features of a candidate between two stretches of text, as a struct of doubles."""
    length = F.length(candidate)
    kinds = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(candidate, "[0-9]", "\u0002"), "[A-Z]", "\u0003"), "[a-z]", "\u0004"
    )
    kinds = F.regexp_replace(kinds, "[^\u0002\u0003\u0004]", "\u0005")
    turns = F.length(F.regexp_replace(kinds, "(.)\\1+", "$1")) - 1
    lowered = F.lower(candidate)
    words = sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w))
    rest = F.length(F.regexp_replace(lowered, "|".join(dict.fromkeys(words)), ""))
    near = F.lower(F.right(before, F.lit(_BEFORE)))
    last = F.regexp_extract(before, "(\\S*)\\s*$", 1)
    values = {
        "length": length,
        "transitions": turns / length,
        "variety": F.size(F.array_distinct(F.split(candidate, ""))) / length,
        "digits": _share(candidate, "0-9", length),
        "uppers": _share(candidate, "A-Z", length),
        "hex": candidate.rlike("^[0-9a-fA-F]+$").cast("double"),
        "known_prefix": candidate.rlike(
            "^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk-|sk_live_|rk_live_|AIza|eyJ|npm_|SG)"
        ).cast("double"),
        "dictionary": 1 - rest / length,
        "path": (
            last.rlike("(https?:|ftp:|[/\\\\.@?&])$|/") | candidate.rlike("^/|/.*/.*[a-z]{4}") | F.left(after, F.lit(2)).rlike("^[.@/\\\\]\\w")
        ).cast("double"),
        "secret_word": near.rlike(f"({_SECRET_WORDS})[^\\n]{{0,24}}$").cast("double"),
        "harmless_word": (near.rlike(f"({_HARMLESS_WORDS})[^\\n]{{0,16}}$") | lowered.rlike("example|dummy|placeholder|sample|your_|xxxx|changeme")).cast(
            "double"
        ),
        "assigned": before.rlike("[=:]\\s?[\"']?$").cast("double"),
    }
    return F.struct(*[values[name].cast("double").alias(name) for name in FEATURES])


def _between(split: Column, place: Column) -> tuple[Column, Column]:
    return F.right(F.get(split, place - 1), F.lit(_BEFORE)), F.left(F.get(split, place + 1), F.lit(_AFTER))


def labelled_findings(per_template: int = 12, seed: int = 5) -> list[tuple[str, int]]:
    """Texts with one candidate each, and whether it is a secret. Drawn from templates by a rule."""
    rng = random.Random(seed)
    sets = {
        "h": "0123456789abcdef",
        "H": "0123456789ABCDEF",
        "d": "0123456789",
        "w": "abcdefghijklmnopqrstuvwxyz",
        "b": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "B": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    }
    secret = (
        'token = "{h40}"|TOKEN = "{H40}"|api_key: {b32}|secret_key="{B40}"|Authorization: Bearer {b48}|password = "{b12}"'
        "|AWS_ACCESS_KEY_ID=AKIA{U16}|aws_secret_access_key = {B40}|ghp_{b36}|the login uses glpat-{b20} for now"
        "|slack xoxb-{d12}-{b24}|sk-{b40}|AIza{b35}|npm_{b36}|private_key: {B64}|client_secret={h64}|passwd: {b10}!{d2}"
        "|auth_token='{b40}'|access_key {h32}|secret: {U24}"
    ).split("|")
    harmless = (
        "commit {h40}|sha256: {h64}|md5 {h32} ok|checksum = {h40}|etag: \"{h32}\"|card {d16} paid|call {d16} now|{d16}"
        "|order no {d18}|uuid {h8}-{h4}-{h4}-{h4}-{h12}|https://www.{w8}.com/{w7}/{w9}/{w12}|see /usr/local/{w6}/{w9}/{w8}.txt"
        "|{w18} {w6}|the {w20} of {w5}|{w9}-{w8}-{w7}|api_key = your_api_key_here|token: example-token-value|password = changeme_please"
        "|import com/company/project/module/{w8}|max_connection_pool_size_{d2}|{D}_{D}_{D}|get{T}From{T}Service|build: {h12}-release-{d8}"
        "|================================|--------------------------------|revision {h40} by {w6}|{w6}.{d2}@mail{d1}.example.com {w17}"
        "|time: {d2}-{d2}-{d4}T{d2}|color: #{h8}|the word {W17} again|fingerprint {h32}|{w10}{w10}, {w4}|{h40}|note: {w12} {w5}"
    ).split("|")

    def fill(template: str) -> str:
        def one(found: re.Match) -> str:
            kind, size = found[1], found[2]
            if kind == "D":
                return rng.choice(DICTIONARY)
            if kind == "T":
                return rng.choice(DICTIONARY).title()
            if kind == "W":
                return "".join(rng.choice(sets["w"]) for _ in range(int(size))).upper()
            return "".join(rng.choice(sets[kind]) for _ in range(int(size)))

        return re.sub(r"\{([A-Za-z])(\d*)\}", one, template)

    leads = ["", "some words before ", "La suite: ", "ther onst.\n", "und der "]
    tails = ["", " and more text", "\n", ". Next", " ther and"]
    return [
        (rng.choice(leads) + fill(template) + rng.choice(tails), label)
        for label, templates in ((1, secret), (0, harmless))
        for template in templates
        for _ in range(per_template)
    ]


def train(spark: SparkSession, trees: int = 25, depth: int = 6, seed: int = 3) -> list[list]:
    """The forest as nested lists ``[feature, threshold, low, high]``; leaves are the share of secrets."""
    rows = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(y).alias("label")) for t, y in labelled_findings()])
    texts = spark.range(1).select(F.explode(rows).alias("r")).select("r.text", F.col("r.label").cast("double").alias("label"))
    split = texts.withColumn("split", parts(F.col("text"))).where(F.size("split") > 1)
    found = split.select(
        "label", features(F.get("split", F.lit(1)), *_between(F.col("split"), F.lit(1))).alias("f")
    ).select("label", "f.*")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found).select("label", "features")
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=2
    ).fit(vectors.coalesce(1))

    def node(java) -> list | float:
        if java.subtreeDepth() == 0:
            stats = list(java.impurityStats().stats())
            return float(stats[1] / sum(stats))
        split = java.split()
        return [FEATURES[split.featureIndex()], float(split.threshold()), node(java.leftChild()), node(java.rightChild())]

    return [node(tree._call_java("rootNode")) for tree in forest.trees]


def score(forest: list, found: Column) -> Column:
    """Mean share of secrets over the trees, for a struct of features."""

    def value(node) -> Column:
        if not isinstance(node, list):
            return F.lit(node)
        name, threshold, low, high = node
        return F.when(found[name] <= threshold, value(low)).otherwise(value(high))

    return reduce(lambda a, b: a + b, [value(tree) for tree in forest]) / len(forest)


def scanned(docs: DataFrame, forest: list, text_column: str = "text") -> DataFrame:
    """``docs`` with ``_split``, its parts, and ``_scores``, one per candidate; both null without candidates."""
    split = parts(F.col(quoted(text_column)))
    with_parts = settle(docs.withColumn("_split", split), "_split")
    places = F.sequence(F.lit(1), F.size("_split") - 2, F.lit(2))
    with_features = with_parts.withColumn(
        "_found",
        F.when(
            F.size("_split") > 1,
            F.transform(places, lambda i: features(F.get("_split", i), *_between(F.col("_split"), i))),
        ),
    )
    return with_features.withColumn("_scores", F.transform("_found", lambda x: score(forest, x))).drop("_found")


def _starts(split: Column) -> Column:
    """Start of every part in the text. Sums run over blocks, so long lists stay cheap."""
    block = 512
    lengths = F.transform(split, F.length)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(split) - 1) / block).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * block + 1, F.lit(block)), F.lit(0), lambda a, x: a + x),
    )
    return F.struct(lengths.alias("lengths"), blocks.alias("blocks"))


def findings(
    docs: DataFrame,
    forest: list,
    threshold: float = 0.5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per candidate: id, ``start`` and ``length`` in the text, ``sha256``, ``score``, ``is_secret``.

    The secret itself is not returned.
    """
    block = 512
    rows = scanned(docs.select(quoted(id_column), quoted(text_column)), forest, text_column).where(F.size("_split") > 1)
    summed = rows.select(quoted(id_column), "_split", "_scores", _starts(F.col("_split")).alias("_sums"))

    def start(k: Column) -> Column:
        place = 2 * k + 1
        whole = F.floor(place / block).cast("int")
        return F.aggregate(
            F.slice("_sums.blocks", F.lit(1), whole), F.lit(0), lambda a, x: a + x
        ) + F.aggregate(
            F.slice("_sums.lengths", whole * block + 1, place - whole * block), F.lit(0), lambda a, x: a + x
        )

    found = F.transform(
        "_scores",
        lambda s, k: F.struct(
            start(k).cast("long").alias("start"),
            F.length(F.get("_split", 2 * k + 1)).cast("long").alias("length"),
            F.sha2(F.get("_split", 2 * k + 1), 256).alias("sha256"),
            s.alias("score"),
            (s >= threshold).alias("is_secret"),
        ),
    )
    return summed.select(quoted(id_column), F.explode(found).alias("f")).select(quoted(id_column), "f.*")


def redacted(docs: DataFrame, forest: list, threshold: float = 0.5, mark: str = "[SECRET]", text_column: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; rows without one are unchanged."""
    apart, back = set_aside(docs, ["_split", "_found", "_scores"])
    rows = scanned(apart, forest, text_column)
    text = F.when(
        F.exists("_scores", lambda s: s >= threshold),
        F.array_join(
            F.transform(
                "_split",
                lambda p, k: F.when((k % 2 == 1) & (F.get("_scores", ((k - 1) / 2).cast("int")) >= threshold), F.lit(mark)).otherwise(p),
            ),
            "",
        ),
    ).otherwise(F.col(quoted(text_column)))
    out = rows.withColumn(text_column, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(F.col(quoted(text_column))).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*[F.col(quoted(c)) for c in apart.columns]).withColumnsRenamed(back)
