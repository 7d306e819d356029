"""Context-tree weighting over bytes: code lengths of texts under a model trained on a corpus.

A byte is eight binary decisions, each with its own tree over the preceding bytes, of all depths up to DEPTH. At every
node a Krichevsky-Trofimov estimate of the node's bits is mixed half and half with what its children say (a child is
one more byte of context). Block probabilities depend on counts alone, so training is aggregation: counts of
(DEPTH + 1)-grams, summed upwards level by level with the children's log probabilities. The mixing weights that come
out are the posterior ones, and prediction mixes the estimates of all depths down the path of a context; where a
context was not seen in training, the path ends at the deepest one that was.

No table of the model is broadcast or collected. Documents are dealt into buckets of about equal bytes, compressed, and a
bucket asks for its distinct grams and words once, packed. Grams are dealt into ranges by their last TOP context bytes: the
trees below such a context are within one range, where they are summed upwards and later walked downwards as arrays; the few
levels above are tables of nodes. A range answers each bucket's packed request with as many values. There are fewer ranges
than buckets when there are many, so that requests don't grow with their square.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutgrain.session import bounded, cut

#: Bytes of context.
DEPTH = 5
#: Bytes of context by which trees are dealt into ranges; a context of so many bytes has its whole subtree in one.
TOP = 3
#: Bytes of text in a bucket, about.
BUCKET = 32 << 20
#: Bytes looked at together in a task.
SLICE = 1 << 21


def _texts(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", held.alias("held_out"), "text")


def grams_of(data: bytes, depth: int) -> np.ndarray:
    """For each byte, it and the `depth` bytes before it as one integer; before a text's start stand zeros."""
    a = np.frombuffer(b"\0" * depth + data, np.uint8).astype(np.uint64)
    got = np.zeros(len(data), np.uint64)
    for i in range(depth + 1):
        got = got << np.uint64(8) | a[i : i + len(data)]
    return got.view(np.int64)


def _slices(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """Arrays of bounded length with the grams of texts, the texts in each, and how many grams each has; long texts are cut."""
    have, own, size, n = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), SLICE):
            lead = min(depth, at)
            g = grams_of(t[at - lead : at + SLICE], depth)[lead:]
            have.append(g)
            own.append(i)
            size.append(len(g))
            n += len(g)
            if n >= SLICE:
                yield np.concatenate(have), own, size
                have, own, size, n = [], [], [], 0
    if have:
        yield np.concatenate(have), own, size


def _packed(texts: DataFrame) -> DataFrame:
    """(bucket, data): runs of a bucket's documents as compressed Arrow streams, which is what is shuffled of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in (whole.slice(at, 4000) for whole in batches for at in range(0, whole.num_rows, 4000)):
            bucket = b.column(0).to_numpy()
            found, data = np.unique(bucket), []
            for k in found:
                sink = pa.BufferOutputStream()
                own = b.select(["doc_id", "held_out", "text"]).filter(pa.array(bucket == k))
                with pa.ipc.new_stream(sink, own.schema, options=how) as w:
                    w.write_batch(own)
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return texts.mapInArrow(run, "bucket int, data binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def pack(x: np.ndarray) -> bytes:
    """Of integers in any order; sorted ones take little space."""
    return zlib.compress(np.diff(x, prepend=np.int64(0)).astype("<i8").tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), "<i8"))


def _merge(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    return g[first], np.add.reduceat(n, first) if len(g) else n


REQUEST = "kind string, range int, bucket int, keys binary, counts binary"


def _unpacked(t: pa.Table) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """The documents of a bucket, a part at a time, and their texts' bytes."""
    for x in t["data"]:
        own = pa.ipc.open_stream(x.as_py()).read_all()
        yield own, [s.encode("utf-8", "replace") for s in own["text"].to_pylist()]


def _ask(packed: DataFrame, depth: int, ranges: int) -> DataFrame:
    """Distinct grams and words of buckets with their number in training texts, as packed requests to ranges; the end of a
    text is the empty word."""
    keep = np.int64((1 << 8 * min(TOP, depth)) - 1)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        some: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        words: Counter = Counter()
        for own, texts in _unpacked(t):
            held = own["held_out"].to_pylist()
            for out in (False, True):
                for part, *_ in _slices([x for x, h in zip(texts, held, strict=True) if h == out], depth):
                    g, n = np.unique(part, return_counts=True)
                    some.append((g, n * (not out)))
                    if sum(len(x) for x, _ in some) > 4_000_000:
                        some = [_merge(*map(np.concatenate, zip(*some, strict=True)))]
            for x, h in zip(texts, held, strict=True):
                w = x.lower().split()
                words.update(dict.fromkeys(w, 0) if h else w)
            words[b""] += held.count(False)
        g, n = _merge(*map(np.concatenate, zip(*some, strict=True)))
        r = (_mixed(g >> 8 & keep) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(r, kind="stable")
        ends = np.searchsorted(r[order], np.arange(ranges + 1))
        rows = [("gram", i, pack(g[at]), zlib.compress(n[at].astype("<i8").tobytes(), 1)) for i in range(ranges) if len(at := order[ends[i] : ends[i + 1]])]
        by: dict[int, list[bytes]] = {}
        for w in sorted(words):
            by.setdefault(zlib.crc32(w) % ranges, []).append(w)
        rows += [("word", i, zlib.compress(b" ".join(ws), 1), zlib.compress(np.array([words[w] for w in ws], "<i8").tobytes(), 1)) for i, ws in by.items()]
        kind, place, keys, counts = zip(*rows, strict=True)
        return pa.table({"kind": pa.array(kind), "range": pa.array(place, pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return packed.groupBy("bucket").applyInArrow(run, REQUEST)


def _table(start: float) -> np.ndarray:
    return np.array([math.lgamma(i + start) for i in range(1 << 12)])


_HALF, _WHOLE = _table(0.5), _table(1.0)


def _lgamma_of(n: np.ndarray, table: np.ndarray, start: float) -> np.ndarray:
    """ln gamma(n + start) of whole n: from a table, beyond it by Stirling's series."""
    x = n + start
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1).astype(np.int64)], big)


def kt_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma_of(a, _HALF, 0.5) + _lgamma_of(b, _HALF, 0.5) - _lgamma_of(a + b, _WHOLE, 1.0) - math.log(math.pi)


class Trees:
    """The levels `top` to `depth` of the trees of some grams: nodes are contexts << 8 | bits of the byte so far, sorted."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, top: int) -> None:
        byte, ctx = grams & 255, grams >> 8
        self.bit = np.concatenate([byte >> 7 - i & 1 for i in range(8)]).astype(bool)
        keys, self.leaf = np.unique(np.concatenate([ctx << 8 | (byte | 256) >> 8 - i for i in range(8)]), return_inverse=True)
        n = np.tile(counts, 8).astype(float)
        a, b = np.bincount(self.leaf, n * ~self.bit, len(keys)), np.bincount(self.leaf, n * self.bit, len(keys))
        own = kt_of(a, b)
        #: level -> (keys, a, b, own estimate, what the children say, place of each node's parent)
        self.levels: dict[int, list] = {depth: [keys, a, b, own, None, None]}
        low = own
        for d in range(depth - 1, top - 1, -1):
            up, place = np.unique((keys >> 8 & (1 << 8 * d) - 1) << 8 | keys & 255, return_inverse=True)
            self.levels[d + 1][5] = place
            a, b, below = (np.bincount(place, x, len(up)) for x in (a, b, low))
            keys, own = up, kt_of(a, b)
            low = np.logaddexp(own, below) - math.log(2)
            self.levels[d] = [keys, a, b, own, below, None]
        self.low, self.depth, self.top = low, depth, top

    def logp(self, mix: np.ndarray, rest: np.ndarray, end: np.ndarray) -> np.ndarray:
        """ln P of each gram's last byte, from the mixtures that reach the nodes of level `top`."""
        for d in range(self.top + 1, self.depth + 1):
            _, a, b, own, below, place = self.levels[d]
            m, r, e = mix[place], rest[place], end[place]
            est, unseen = (b + 0.5) / (a + b + 1), a + b == 0
            weight = 1.0 if below is None else 1 / (1 + np.exp(np.minimum(below - own, 700)))
            end = np.where(unseen, e, m + r * est)
            mix, rest = np.where(unseen, m, m + r * weight * est), np.where(unseen, r, r * (1 - weight))
        p = end[self.leaf]
        return np.log(np.where(self.bit, p, 1 - p)).reshape(8, -1).sum(0)


def _read(t: pa.Table) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    keys = [unpack(x) for x in t["keys"].to_pylist()]
    return t["bucket"].to_pylist(), keys, [np.frombuffer(zlib.decompress(x), "<i8") for x in t["counts"].to_pylist()]


def _nodes(asked: DataFrame, depth: int, top: int) -> DataFrame:
    """Requests -> nodes of level `top`: (ctx, node, a, b, own, below, lw)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        _, keys, counts = _read(t)
        trees = Trees(*_merge(np.concatenate(keys), np.concatenate(counts)), depth, top)
        k, a, b, own, below, _ = trees.levels[top]
        return pa.table({"ctx": k >> 8, "node": (k & 255).astype(np.int32), "a": a.astype(np.int64), "b": b.astype(np.int64), "own": own, "below": own if below is None else below, "lw": trees.low})

    return asked.groupBy("range").applyInArrow(run, "ctx long, node int, a long, b long, own double, below double, lw double")


def _answer_grams(asked: DataFrame, reach: DataFrame, depth: int, top: int, ranges: int) -> DataFrame:
    """Requests and the mixtures at level `top` -> (bucket, kind, keys, values): each bucket's grams with their ln P."""

    def run(key: tuple, t: pa.Table, nodes: pa.Table) -> pa.Table:
        buckets, keys, counts = _read(t)
        grams, n = _merge(np.concatenate(keys), np.concatenate(counts)) if keys else (np.empty(0, np.int64),) * 2
        out: list[list] = [[], [], []]
        if len(grams):
            trees = Trees(grams, n, depth, top)
            k = nodes["ctx"].to_numpy() << 8 | nodes["node"].to_numpy()
            order = np.argsort(k)
            place = order[np.searchsorted(k[order], trees.levels[top][0])]
            logp = trees.logp(*(nodes[c].to_numpy()[place] for c in ("mix", "rest", "end")))
            for b in sorted(set(buckets)):
                own = np.unique(np.concatenate([x for x, y in zip(keys, buckets, strict=True) if y == b]))
                out[0].append(b)
                out[1].append(pack(own))
                out[2].append(logp[np.searchsorted(grams, own)].astype("<f8").tobytes())
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "kind": pa.array(["gram"] * len(out[0])), "keys": pa.array(out[1], pa.binary()), "values": pa.array(out[2], pa.binary())})

    keep = (1 << 8 * top) - 1
    # the same range as _ask() gives: computed where rows are few, in Python
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ctx = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((_mixed(ctx & keep) % np.uint64(ranges)).astype(np.int32)), *b.columns], names=["range", *b.schema.names])

    dealt = reach.select("ctx", "node", "mix", "rest", "end").mapInArrow(place, "range int, ctx long, node int, mix double, rest double, end double")
    return asked.groupBy("range").cogroup(dealt.groupBy("range")).applyInArrow(run, "bucket int, kind string, keys binary, values binary")


def _lgamma(x: Column) -> Column:
    """ln gamma(x), x > 0, by Stirling's series after a shift by 7; to about 1e-13."""
    shift = x
    for i in range(1, 7):
        shift = shift * (x + i)
    y = x + 7
    z = 1 / (y * y)
    series = (1.0 / 12 - z * (1.0 / 360 - z * (1.0 / 1260 - z * (1.0 / 1680)))) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(shift)


def kt(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    a, b = a.cast("double"), b.cast("double")
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)


def _reach(nodes: DataFrame, top: int) -> DataFrame:
    """Nodes of level `top` -> (ctx, node, mix, rest, end): what reaches them from the root.

    mix is the mixture of estimates so far, rest the weight that deeper ones still have, end the probability of a one if the
    path ended here. The levels above `top` are few rows: at most 256^top contexts.
    """
    levels = [nodes]
    for d in range(top - 1, -1, -1):
        up = levels[0].groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1).cast("long")).alias("ctx"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("below"))
        up = up.select("ctx", "node", "a", "b", kt(F.col("a"), F.col("b")).alias("own"), "below")
        high, low = F.greatest("own", "below"), F.least("own", "below")
        levels.insert(0, cut(up.withColumn("lw", high + F.log1p(F.exp(low - high)) - math.log(2))))
    stop = 1 / (1 + F.exp(F.least(F.col("below") - F.col("own"), F.lit(700.0))))  # posterior weight of a node's own estimate
    est = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)  # of a one
    now = levels[0].select("ctx", "node", (stop * est).alias("mix"), (1 - stop).alias("rest"), est.alias("end"))
    for d in range(1, top + 1):
        up = now.select(F.col("ctx").alias("uctx"), F.col("node").alias("unode"), F.col("mix").alias("m"), F.col("rest").alias("r"), F.col("end").alias("e"))
        here = levels[d].withColumn("uctx", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1).cast("long"))).withColumn("unode", F.col("node"))
        unseen = F.col("a") + F.col("b") == 0
        now = here.join(up, ["uctx", "unode"]).select(
            "ctx",
            "node",
            F.when(unseen, F.col("m")).otherwise(F.col("m") + F.col("r") * stop * est).alias("mix"),
            F.when(unseen, F.col("r")).otherwise(F.col("r") * (1 - stop)).alias("rest"),
            F.when(unseen, F.col("e")).otherwise(F.col("m") + F.col("r") * est).alias("end"),
        )
    return now


def _answer_words(asked: DataFrame) -> DataFrame:
    """Requests -> (bucket, kind, keys, values, n, kinds): each bucket's words with their counts; a range's totals in bucket -1."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        words = [zlib.decompress(x).split(b" ") for x in t["keys"].to_pylist()]
        counts = [np.frombuffer(zlib.decompress(x), "<i8").tolist() for x in t["counts"].to_pylist()]
        total: Counter = Counter()
        for ws, ns in zip(words, counts, strict=True):
            for w, n in zip(ws, ns, strict=True):
                total[w] += n
        rows = [(-1, b"", b"", sum(total.values()), sum(n > 0 for n in total.values()))]
        rows += [(b, zlib.compress(b" ".join(ws), 1), zlib.compress(np.array([total[w] for w in ws], "<f8").tobytes(), 1), 0, 0) for b, ws in zip(t["bucket"].to_pylist(), words, strict=True)]
        bucket, keys, values, n, kinds = zip(*rows, strict=True)
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "kind": pa.array(["word"] * len(rows)), "keys": pa.array(keys, pa.binary()), "values": pa.array(values, pa.binary()), "n": pa.array(n, pa.int64()), "kinds": pa.array(kinds, pa.int64())})

    return asked.groupBy("range").applyInArrow(run, "bucket int, kind string, keys binary, values binary, n long, kinds long")


SCORE = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64())]


def score(docs: DataFrame, depth: int = DEPTH, bucket_bytes: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte).

    Documents whose crc32(doc_id as text) mod 7 is not 2 train both models; all are scored. score is log10 of the
    context-tree model's probability of the text's UTF-8 bytes; base_score that of an add-one unigram model of lower-cased
    words and an end. A null or empty text has no bytes (score 0) and one token, the end. Null ids count as training
    documents. Rows that repeat an id are scored one by one. A text of any length is scored whole: it is
    packed into one bucket, which is as large as it is. An empty table gives no rows; other columns are dropped.
    """
    if not 1 <= depth <= 6:
        raise ValueError("a gram has to fit 63 bits: depth is 1 to 6")
    size = bounded(docs).agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    ranges = min(buckets, math.ceil(16 * math.sqrt(buckets)))
    packed, top = _packed(_texts(docs, buckets, id_col, text_col)), min(TOP, depth)

    asked = cut(_ask(packed, depth, ranges))
    grams = asked.where("kind = 'gram'").drop("kind")
    reach = _reach(cut(_nodes(grams, depth, top)), top)
    words = cut(_answer_words(asked.where("kind = 'word'").drop("kind")))
    n_train, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    answers = _answer_grams(grams, reach, depth, top, ranges).union(words.where("bucket >= 0").drop("n", "kinds"))
    floor = math.log10(n_train + vocabulary + 1)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        g, lp, known = [np.empty(0, np.int64)], [np.empty(0)], {}
        for kind, k, v in zip(right["kind"].to_pylist(), right["keys"].to_pylist(), right["values"].to_pylist(), strict=True):
            if kind == "gram":
                g.append(unpack(k))
                lp.append(np.frombuffer(v, "<f8"))
            else:
                known.update(zip(zlib.decompress(k).split(b" "), np.frombuffer(zlib.decompress(v), "<f8").tolist(), strict=True))
        g, lp = np.concatenate(g), np.concatenate(lp)
        order = np.argsort(g)
        g, lp = g[order], lp[order]
        out = [pa.table({c: pa.array([], t) for c, t in SCORE})]
        for own, texts in _unpacked(left):
            nats, n = np.zeros(len(texts)), np.array([len(x) for x in texts], np.int64)
            for part, docs_in, sizes in _slices(texts, depth):
                kinds, which = np.unique(part, return_inverse=True)
                sums = np.add.reduceat(lp[np.searchsorted(g, kinds)][which], np.cumsum(sizes) - sizes)
                np.add.at(nats, docs_in, sums)
            tokens, seen, base = [], [], []
            for x in texts:
                c = np.array([*map(known.__getitem__, x.lower().split()), known[b""]])
                tokens.append(len(c))
                seen.append(np.count_nonzero(c))
                base.append(np.log10(c + 1).sum() - len(c) * floor)
            cols = [own["doc_id"], own["held_out"], tokens, seen, [n_train] * len(n), base, nats / math.log(10), n, -nats / math.log(2) / np.maximum(n, 1)]
            out.append(pa.table({c: x if isinstance(x, pa.ChunkedArray) else pa.array(x, t) for (c, t), x in zip(SCORE, cols, strict=True)}))
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return packed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, schema)
