"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

DataFrame functions only. One model is trained on random strings, the other on ordinary identifiers and words, both from
a table of labelled samples. A token of a text is a secret where the log-likelihood ratio of its characters' transitions
exceeds a threshold, which held-out samples of both kinds decide. Spans of the patterns are always reported; the models add those of
other tokens.

Offsets come from splitting a text at a pattern: the pieces' and the matches' lengths add up to positions. Sums run
over blocks of matches, so that many matches in one text don't cost their square.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutgrain.session import cut, unused

#: kind -> (pattern, group that is measured, least length of it), in the order in which kinds are listed.
PATTERNS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Tokens that the models look at; shorter ones say too little.
TOKEN = r"[A-Za-z0-9+/_=-]+"
LEAST_TOKEN = 12
#: Shares of the held-out ordinary samples that may exceed the threshold, and of the random ones, cut to SHORT characters, that
#: may stay below it where both can be had; and one in how many samples is held out.
FALSE_ALARMS = 1e-3
MISSES = 1e-2
SHORT = 16
HELD_OUT = 4
#: Documents from which samples are taken, about, and in how many of them a word has to stand to be an ordinary one.
SAMPLE_DOCS = 5000
WORD_DOCS = 3
BLOCK = 256

#: Classes of characters in transitions: letters and digits stand for themselves, the rest for one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

#: Parts of ordinary identifiers, for the built-in samples (fixed values).
IDENTIFIER_PARTS = (
    "account active add all amount apply array async attribute available backend balance base batch before begin block body border bottom buffer build byte cache callback "
    "cancel category center change channel character check child class clear client close code collection color column command comment commit common compare complete "
    "component config connect console constant container content context control convert copy count create current cursor custom data database date debug default define "
    "delete description device dialog directory disable display document domain download driver duration dynamic edit element email enable encode end engine entry error "
    "event example execute exist expand export expression external factory failure feature fetch field file filter final find first fixed flag float focus folder font "
    "footer force foreground form format frame from function future gateway general generate get global graph group handle handler hash header height helper hidden "
    "history host icon identifier image import include index initial input insert instance integer interface internal invalid item iterator join key label language last "
    "layer layout left length level library limit line link list listener load local location lock logger login loop main manager map margin mask match maximum member "
    "memory menu merge message method middle minimum mode model module monitor mouse move name native network next node normal notification null number object offset "
    "open operation option order original output owner package page panel parameter parent parse password path pattern payment percent permission persistent picture "
    "pixel platform player plugin point policy pool port position prefix prepare previous primary print private process product profile progress project property "
    "protocol provider public query queue random range rate read receive record refresh region register relation release remote remove render repeat replace report "
    "request required reset resource response result retry return right role root rotate route row rule run sample save scale schedule schema screen script scroll search "
    "second section segment select send sequence server service session set setting shadow shape share shift show signal simple size slice socket sort source space start "
    "state static status step storage store stream string style submit subject success suffix summary support switch symbol sync system table target task template "
    "temporary test text theme thread threshold time timeout title toggle token tool total trace track transaction transform tree trigger type unique unit update upload "
    "user utility valid value variable vector verify version vertical video view visible visitor wait warning width window word worker wrapper write zone"
).split()


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratios of transitions between classes of characters, row by row, and the sum from which a token is random."""

    ratios: tuple[float, ...]
    classes: int
    threshold: float = math.inf


def default_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled samples (text, random): n random strings of several alphabets, and n ordinary identifiers."""
    i = spark.range(n)
    seed = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    raw = F.unhex(seed)
    random = F.when(F.col("id") % 4 == 0, F.base64(raw)).when(F.col("id") % 4 == 1, F.substring(seed, 1, 40)).when(F.col("id") % 4 == 2, F.regexp_replace(F.base64(raw), "[^A-Za-z0-9]", "")).otherwise(F.upper(F.regexp_replace(F.base64(raw), "[^A-Za-z0-9]", "")))
    parts = F.array(*[F.lit(x) for x in IDENTIFIER_PARTS])
    part = lambda k: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_PARTS))) + 1).cast("int"))
    words = [part(k) for k in range(4)]
    plain = (
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", *words))
        .when(F.col("id") % 4 == 1, F.concat(words[0], *[F.initcap(x) for x in words[1:]]))
        .when(F.col("id") % 4 == 2, F.concat_ws("/", *words))
        .otherwise(F.upper(F.concat_ws("-", *words)))
    )
    return i.select(random.alias("text"), F.lit(True).alias("random")).union(i.select(plain, F.lit(False)))


def samples_of(docs: DataFrame, about: int = SAMPLE_DOCS, text_col: str = "text") -> DataFrame:
    """Labelled samples (text, random) from about so many documents: what the patterns' measured groups hold is random, words
    of several of these documents are ordinary. Null texts give none."""
    part = min(1.0, about / max(1, docs.count()))
    some = docs.select(F.col(text_col).cast("string").alias("text")).where(F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1 << 20)) < int(part * (1 << 20)))
    found = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g, _ in PATTERNS.values()]))
    found = F.filter(found, lambda x: (F.char_length(x) >= LEAST_TOKEN) & x.rlike("[0-9]"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?<![A-Za-z])[A-Za-z]{{{LEAST_TOKEN // 2},}}(?![A-Za-z])"), F.lit(0)))
    said = lambda xs, random: F.transform(xs, lambda x: F.struct(x.alias("text"), F.lit(random).alias("random")))
    each = some.select(F.explode(F.concat(said(found, True), said(words, False))).alias("s")).select("s.*")
    return each.groupBy("text", "random").agg(F.count("*").alias("n")).where(f"random or n >= {WORD_DOCS}").select("text", "random")


def _class(c: Column) -> Column:
    """0: other; from 1 on the place in ALPHABET."""
    return F.instr(F.lit(ALPHABET), c)


def train(samples: DataFrame) -> Markov:
    """(text, random boolean) -> add-half estimates of both chains. The result has a fixed size, whatever the samples'.

    One in HELD_OUT samples, by a hash of its text, isn't trained on; those of a token's length decide on the threshold. At most
    FALSE_ALARMS of the ordinary ones exceed it; where it can be higher and no more than MISSES of the beginnings of random ones
    stay below, it is half-way between both. Null texts and labels, and texts of fewer than two characters, count nothing; without
    held-out samples of both kinds nothing is random.
    """
    k = len(ALPHABET) + 1
    samples = cut(samples.where("random is not null and char_length(text) > 1"))
    held = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(HELD_OUT)) == 0
    letters = F.split(F.col("text"), "")
    two = F.arrays_zip(F.slice(letters, F.lit(1), F.size(letters) - 1).alias("a"), F.slice(letters, F.lit(2), F.size(letters) - 1).alias("b"))
    pairs = samples.where(~held).select("random", F.explode(two).alias("t"))
    counted = pairs.groupBy("random", _class(F.col("t.a")).alias("a"), _class(F.col("t.b")).alias("b")).count()
    n = {True: [[0.5] * k for _ in range(k)], False: [[0.5] * k for _ in range(k)]}
    for r in counted.collect():  # at most 2 x 63 x 63 rows
        n[r["random"]][r["a"]][r["b"]] += r["count"]
    ratios = [math.log(n[True][a][b] / sum(n[True][a])) - math.log(n[False][a][b] / sum(n[False][a])) for a in range(k) for b in range(k)]
    model = Markov(tuple(round(x, 6) for x in ratios), k)
    ratio = _ratio(F.when(F.col("random"), F.substring("text", 1, SHORT)).otherwise(F.col("text")), model)
    tokens = samples.where(held & (F.char_length("text") >= LEAST_TOKEN)).select("random", ratio.alias("ratio"))
    high, low = tokens.agg(F.percentile(F.when(~F.col("random"), F.col("ratio")), F.lit(1 - FALSE_ALARMS)), F.percentile(F.when(F.col("random"), F.col("ratio")), F.lit(MISSES))).first()
    if high is None or low is None:
        return model
    return Markov(model.ratios, k, round(max(high, (high + low) / 2), 6))


def _ratio(x: Column, model: Markov) -> Column:
    """Sum of the log-likelihood ratios of a token's transitions."""
    ratios = F.array(*[F.lit(v) for v in model.ratios])
    steps = F.transform(F.sequence(F.lit(1), F.char_length(x) - 1), lambda i: F.element_at(ratios, _class(F.substr(x, i, F.lit(1))) * model.classes + _class(F.substr(x, i + 1, F.lit(1))) + 1))
    return F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end>>: code-point offsets of all leftmost matches, as split and extract see them."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    both = F.zip_with(gaps, sizes, lambda g, s: F.struct(g.alias("g"), F.coalesce(s, F.lit(0)).alias("s")))  # one gap more than matches
    n = F.size(sizes)

    def sums(start: Column, items: Column) -> Column:
        empty = F.struct(start.alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["s"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["s"]).alias("end")))).alias("out"))
        return F.aggregate(items, empty, step, lambda acc: acc["out"])

    # blocks of matches: first each block's start, then the sums within
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: F.slice(both, i * BLOCK + 1, F.least(F.lit(BLOCK), n - i * BLOCK)))
    lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["g"] + x["s"]))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    found = F.flatten(F.transform(F.arrays_zip(F.slice(starts, F.lit(1), F.size(blocks)).alias("at"), blocks.alias("items")), lambda z: sums(z["at"], z["items"])))
    return F.when(n > 0, found).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))


def _kind(text: Column, kind: str) -> Column:
    pattern, group, least = PATTERNS[kind]
    # only texts that hold a match long enough are searched with offsets
    quick = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}[kind]
    spans = _located(text, pattern if kind == "assign" else {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}[kind])
    if group:
        measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length)
        spans = F.zip_with(spans, measured, lambda s, m: F.when(m >= least, s))
        spans = F.filter(spans, lambda s: s.isNotNull())
    tagged = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(list(PATTERNS).index(kind)).alias("rank"), s["end"].alias("end")))
    return F.when(F.col("text").rlike(quick), tagged).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)"))


def _random(text: Column, model: Markov) -> Column:
    """Tokens that the chain of random strings explains better."""
    token = rf"{TOKEN[:-1]}{{{LEAST_TOKEN},}}"
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")
    tokens = F.regexp_extract_all(text, F.lit(token), F.lit(0))
    said = F.transform(tokens, lambda x: _ratio(x, model) > model.threshold)  # most texts have none, and need no offsets
    tagged = F.zip_with(_located(text, token), said, lambda s, hit: F.when(hit, F.struct(s["start"].alias("start"), F.lit(len(PATTERNS)).alias("rank"), s["end"].alias("end"))))
    return F.when(F.exists(said, lambda hit: hit), F.filter(tagged, lambda s: s.isNotNull())).otherwise(none)


def scan(docs: DataFrame, model: Markov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, text, base, added): spans as array<struct<start, rank, end>> by start, then kind as listed.

    rank counts the kinds of PATTERNS in order; the models' kind comes after them. The models add only tokens that no base
    span touches. A null text counts as empty and has no spans; rows are independent, so null and
    repeated ids are kept; other columns are dropped; an empty table gives no rows. A text of any length is scanned whole in
    its row, in time linear in its length but for added spans, each of which is held against all of its base spans.
    """
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.select("doc_id", "text", *[_kind(F.col("text"), k).alias(k) for k in PATTERNS], _random(F.col("text"), model).alias("found"))
    t = t.select("doc_id", "text", F.array_sort(F.concat(*PATTERNS)).alias("base"), "found")
    added = F.filter("found", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return t.select("doc_id", "text", "base", added.alias("added"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in [*PATTERNS, "random"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, model: Markov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans)."""
    got = scan(docs, model, id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == list(PATTERNS).index(k))).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *[count(k) for k in PATTERNS], F.size("added").cast("long").alias("n_random"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame, model: Markov, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span in text replaced by mark (overlapping spans by one); all other columns as they are.

    A null text stays null; rows are independent, so null and repeated ids are kept, whatever the columns are named. A text
    is put together anew at each of its spans. An empty table gives no rows.
    """
    kinds = [_kind_of(k) for k in PATTERNS]
    spans = F.array_sort(F.concat(*kinds, _random_of(model)))
    own = unused(docs, "spans")
    t = docs.withColumn(own, spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.when(x["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), fresh.alias("out"))

    done = F.aggregate(own, start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    return t.withColumn("text", F.when(F.size(own) > 0, done).otherwise(F.col("text"))).drop(own)


def _kind_of(kind: str) -> Column:
    return F.coalesce(_kind(F.coalesce(F.col("text"), F.lit("")), kind), F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)"))


def _random_of(model: Markov) -> Column:
    return F.coalesce(_random(F.coalesce(F.col("text"), F.lit("")), model), F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)"))
