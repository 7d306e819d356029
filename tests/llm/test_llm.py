"""Training-data operators against brute force, on small tables that hold the awkward cases."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cutgrain.llm import bpe, chat, covertree, ctw, minhash, packing, rabitq, registry, secrets, substrings, toxicity, words
from cutgrain.llm.shingles import shingles, word_hashes
from cutgrain.session import table

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def say(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


LONG = say(1, 30_000)
BASE = say(2, 120)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("alpha", "ALPHA", 1)), (4, BASE + " one two"), (5, None), (6, ""), (7, "   \n\t "), (8, "single"),
    (9, LONG), (10, LONG + " x"), (11, say(3, 80) + ". " + BASE + ".\nEnd."), (12, say(4, 80) + ". " + BASE + ".\nEnd."), (12, say(5, 9)), (12, say(5, 9)), (None, BASE),
    (13, "\x00 日本 🎉  ñ\r\n\r\n   'll <|endoftext|> ²"), (14, "a" * 5000), (15, BASE.replace(" ", "\n")), (-7, "token=abcdefghijkl12 " * 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    # other columns clash with the operators' own names
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumn("n", F.lit("x")).withColumn("rank", F.lit(0)).withColumn("score", F.lit(None).cast("string")).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


# op1


def ctw_by_hand(texts, depth):
    """id -> (score, base_score), one node at a time."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    node, words = collections.defaultdict(lambda: [0, 0]), collections.Counter()
    data = [(i, (t or "").encode()) for i, t in texts]
    bits = lambda x: [(1 << j | x >> 8 - j, x >> 7 - j & 1) for j in range(8)]
    for i, b in data:
        if not held(i):
            p = b"\0" * depth + b
            for k in range(depth, len(p)):
                for n, bit in bits(p[k]):
                    for d in range(depth + 1):
                        node[d, p[k - d : k], n][bit] += 1
            words.update([*b.lower().split(), b""])
    kt = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in node.items()}
    low, below = dict(kt), collections.defaultdict(float)
    for d in range(depth, -1, -1):
        for key in [k for k in node if k[0] == d]:
            if d < depth:
                low[key] = np.logaddexp(kt[key], below[key]) - math.log(2)
            if d:
                below[d - 1, key[1][1:], key[2]] += low[key]
    total, kinds = sum(words.values()), sum(n > 0 for n in words.values())
    out = []
    for i, b in data:
        p, nats = b"\0" * depth + b, 0.0
        for k in range(depth, len(p)):
            for n, bit in bits(p[k]):
                mix, rest, end = 0.0, 1.0, 0.5
                for d in range(depth + 1):
                    if (key := (d, p[k - d : k], n)) not in node:
                        break
                    a, c = node[key]
                    est = (c + 0.5) / (a + c + 1)
                    end = mix + rest * est
                    stop = 1 / (1 + math.exp(min(700, below[key] - kt[key]))) if d < depth else 1
                    mix, rest = mix + rest * stop * est, rest * (1 - stop)
                nats += math.log(end if bit else 1 - end)
        tokens = [*b.lower().split(), b""]
        out.append((i, held(i), len(tokens), sum(words[w] > 0 for w in tokens), total, sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in tokens), nats / math.log(10)))
    return out


@pytest.mark.parametrize("depth", [1, 5])
def test_ctw(docs, nothing, depth, monkeypatch):
    monkeypatch.setattr(ctw, "SLICE", 700)
    short = docs.where("text is null or length(text) < 6000")
    got = ctw.score(short, depth=depth, bucket_bytes=4000).collect()
    want = ctw_by_hand([(r.doc_id, r.text) for r in short.collect()], depth)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:7] == pytest.approx(w[5:7], abs=1e-6)
    assert ctw.score(nothing).collect() == []


# op2


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((400, 16))
    x[100:160] = x[100] + 0.05 * r.standard_normal((60, 16))
    x[200:230] = x[200]
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 3 if i < 390 else None) for i in range(400)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, [float("inf")] * 16, 1), (1005, [1.0] * 4, 1), (1006, [], 1), (None, rows[0][1], 1)]
    rows += [(20, rows[20][1], 2), (100, rows[100][1], 1)]
    return spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("x")).repartition(3).cache()


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


def nearest_by_hand(rows, k):
    """(query row's id, [(vec_id, score)]) of every query row."""
    for n, (i, v) in enumerate(rows):
        if i % 20 == 0:
            yield i, sorted(((j, float((x * v).sum())) for m, (j, x) in enumerate(rows) if m != n and len(x) == len(v)), key=lambda p: (-p[1], p[0]))[:k]


def test_search(vectors, monkeypatch):
    monkeypatch.setattr(rabitq, "CANDIDATES", 90)
    monkeypatch.setattr(rabitq, "QUERIES", 7)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect() if r.vec_id is not None and usable(r.embedding)]
    for k in (20, 1000):
        got = collections.defaultdict(collections.Counter)
        for r in rabitq.search(vectors, F.col("vec_id") % 20 == 0, k).collect():
            got[r.query_id][r.rank, r.vec_id, round(r.score, 9)] += 1
        want = collections.defaultdict(collections.Counter)
        for i, best in nearest_by_hand(rows, k):
            want[i].update((n, j, round(s, 9)) for n, (j, s) in enumerate(best, 1))
        assert got.keys() == want.keys() and all(got[i].total() == want[i].total() for i in want)
        hit = sum((got[i] & want[i]).total() for i in want)
        assert hit >= 0.99 * sum(c.total() for c in want.values())
    assert rabitq.search(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_search_of_huge_vectors_and_ties(spark):
    r = np.random.default_rng(6)
    x = [r.standard_normal(64) for _ in range(38)]
    rows = [(0, [3e38 * s for s in (1, -1) * 32])] + [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[0].tolist()) for i in range(60)] + [(40, (x[0] * 2).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for q in rabitq.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    for i, best in nearest_by_hand([(i, np.array(v)) for i, v in rows], 20):
        assert [j for j, _ in got[i]] == [j for j, _ in best] and [s for _, s in got[i]] == pytest.approx([s for _, s in best], rel=1e-12)


def test_bounds():
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 64))
    codes, length, cosine = rabitq.encode(x[100:])
    q = x[:100] / np.linalg.norm(x[:100], axis=1, keepdims=True)
    est, bound = rabitq.estimate(codes, cosine, q)
    error = est - q @ (x[100:] / length[:, None]).T
    assert (np.abs(error) <= bound).mean() > 0.99 and abs(error.mean()) < 0.01


# op3


def words_of(t):
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0d]+", t or "")]


def check_removed(rows, least_line=1):
    """What each row lost is as told, stood earlier too, and no repeated line is left twice. rows: (rank, text, new text, removed)."""
    grams = sorted({1, 2, 3, substrings.GRAM + 1})
    first, lines = {}, collections.defaultdict(list)
    for rank, t, _, _ in rows:
        w = words_of(t)
        for i in range(len(w)):
            for n in grams:
                key = tuple(x[2] for x in w[i : i + n])
                first[key] = min(first.get(key, (rank, i)), (rank, i))
    for rank, t, new, removed in rows:
        if t is None:
            assert new is None and removed == []
            continue
        at, kept = 0, ""
        for a, z in removed:
            assert at <= a < z <= len(t)
            kept, at = kept + t[at:a], z
        assert new == kept + t[at:]
        w = words_of(t)
        for a, z in removed:
            inside = [i for i, x in enumerate(w) if a <= x[0] and x[1] <= z]
            n = min(substrings.GRAM + 1, len(inside))
            assert n >= least_line
            for i in inside[: len(inside) - n + 1]:
                n_ = n if n in grams else 3
                assert first[tuple(x[2] for x in w[i : i + n_])] < (rank, i)
        gone = {i for a, z in removed for i in range(a, z)}
        for m in re.finditer(r"[^\n]+", t):
            key = " ".join(m[0].lower().split())
            if len(key.split()) >= least_line:
                whole = any(i not in gone and not t[i].isspace() for i in range(*m.span()))
                lines[key].append(((rank, m.start()), whole))
    for places in lines.values():
        places.sort()
        assert not any(stays for _, stays in places[1:]), places
    return lines


@pytest.mark.parametrize("least_line", [1, 3])
def test_lines_and_passages(spark, docs, nothing, least_line):
    r, line = random.Random(8), "all rights kept by the makers"
    shared = [say(50 + i, n) for i, n in enumerate((50, 63, 90, 51))]
    rows = [(i, f"{say(200 + i, r.randint(0, 30))} {shared[i % 4]} é日 {say(300 + i, r.randint(1, 30))}") for i in range(24)]
    rows += [(100 + i, f"{say(400 + i, 9)}\n{line}\nyes\n{say(500 + i, 9)}\n\none two\nthree {'x' * (i % 2)}\n\n{'la ' * 70}end{i}\n") for i in range(4)]
    rows += [(200, ""), (201, " \n"), (202, "\n" + line.upper() + "  \n"), (203, None), (204, LONG), (205, "x " + LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1)).withColumn("late", F.lit(2)).withColumn("h1", F.lit(3)).repartition(3)
    got = {x.doc_id: x for x in substrings.dedup(df, least_line).collect()}
    check_removed([(i, t, got[i].text, [tuple(x) for x in got[i].removed]) for i, t in rows], least_line)
    assert got[5].late == 2 and got[202].text.strip() == "" and got[101].text.count(line) == 0 and ("yes" in got[101].text) == (least_line > 1)
    for i in range(24):  # a passage within a sentence goes but for what stands before its first border
        lost = len(words_of(rows[i][1])) - len(words_of(got[i].text))
        assert lost == 0 if i < 4 else lost >= len(shared[i % 4].split()) - 2 * substrings.WIDTH
    assert got[204].removed == [] and len(got[205].text.split()) <= 1 + substrings.WIDTH
    assert substrings.dedup(nothing).collect() == []


def test_every_later_line_goes(spark):
    """Whatever its length, by a walk over all lines in order."""
    r = random.Random(14)
    rows = [(i, "\n".join(r.choice(["same line", "One", "one", "one two", f"own {i} {k} words", "other words  stand here", "", f"{i} {k}"]) for k in range(r.randint(0, 9)))) for i in range(60)]
    rows += [(100, "same line\nend one two three"), (101, "same line\nother words stand here\nnew"), (102, "uno\nuno\nuno dos\nuno dos"), (103, None)]
    seen, want = set(), {}
    for i, t in rows:
        left = []
        for x in (t or "").split("\n"):
            key = "".join(x.lower().split())
            if key and key not in seen:
                left.append(x)
            seen |= {key}
        want[i] = left
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.text for x in substrings.dedup(df, least_run=10**6).collect()}
    assert {i: [x for x in (t or "").split("\n") if x.strip()] for i, t in got.items()} == want and got[103] is None


def test_repeated_ids_lose_no_text(spark):
    a, b, c, d = (say(70 + i, 40) for i in range(4))
    rows = [(2, f"{a} {b}"), (2, c), (2, c), (2, c), (3, a), (5, d), (5, d + "\nplus one line here"), (None, a), (None, a), (None, "")]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    texts = collections.Counter((r.doc_id, r.text) for r in got)
    assert texts[2, f"{a} {b}"] == 1 and texts[2, c] == 1 and texts[2, ""] == 2 and texts[None, a] == 2
    assert len(next(r.text for r in got if r.doc_id == 3).split()) <= substrings.WIDTH
    left = " ".join(r.text for r in got if r.doc_id == 5).split()
    assert 40 + 4 <= len(left) <= 40 + 4 + substrings.WIDTH + substrings.GRAM and set(d.split()) <= set(left)


# op4


def test_chat(spark):
    hard = "\\<|\\\\<||>\n<"
    rows = [(-1, 0, "user", registry.TRAP), (-1, 1, "assistant", registry.TRAP), (1, 1, "assistant", hard), (1, 0, "user", None), (2, 0, "a\n\\|n<|b\\", "\\|n"), (2, None, None, "x"), (2, 0, "a\n\\|n<|b\\", "\\|n"), (None, 0, "system", "s"), (3, 0, "assistant", "ok"), (4, 0, "user", "é" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(7))
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss))
    assert {c: r.valid for c, r in got.items()} == {-1: True, 1: True, 2: False, None: False, 3: False, 4: False}
    assert chat.digest(chat.format_chats(df.limit(0))).collect() == []


# op5 and op6


def test_pieces_cover_every_id(docs, nothing):
    t = Tokenizer.from_file(JSON)
    rows = packing.pack(docs, JSON, PATTERN, window=256, per_packer=5).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, text in TEXTS:
        if i == 12:
            continue
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert [(r.start, r.length, r.doc_tokens) for r in sorted(by[i], key=lambda r: r.start)] == [(s, min(256, len(ids) - s), len(ids)) for s in range(0, len(ids), 256)]
        for r in by[i]:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert len([r for r in by[12] if r.start == 0]) == 3
    full = collections.defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(nothing, JSON, PATTERN).collect() == []


def test_sum_of_squares():
    r, w = random.Random(5), 64
    to, level, at = packing.SumOfSquares(w), collections.Counter(), {}
    for _ in range(3000):
        size = r.randint(1, w)
        cost = {}
        for h in [0, *[h for h, n in level.items() if n and 0 < h <= w - size]]:
            after = level.copy()
            after[h] -= h > 0
            after[h + size] += h + size < w
            cost[h] = sum(n * n for n in after.values())
        s, o = to.place(size)
        assert at.get(s, 0) == o and cost[o] == min(cost.values())
        level[o] -= o > 0
        at[s] = o + size
        level[o + size] += o + size < w
    assert sum(at.values()) / (len(at) * w) > 0.97


def test_bpe(docs, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i is None, i or 0, len(ids := t.encode_ordinary(x or "")), sha(" ".join(map(str, ids)).encode()), sha((x or "").encode())) for i, x in TEXTS)
    got = bpe.round_trip(docs, RANKS, PATTERN).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).where("doc_id <> 12").collect()
    assert {r.doc_id: bytes(r.data).decode() for r in back} == {i: x or "" for i, x in TEXTS if i not in (12, None)}
    assert bpe.round_trip(nothing, RANKS, PATTERN).collect() == []


def test_word_borders(monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, fast, slow = bpe.Bpe(RANKS, PATTERN), packing._Ids(JSON, PATTERN), Tokenizer.from_file(JSON)
    bits, r = ["a", " ", "  ", "\n", "\t", "\n\n", " \n", "é", "foo", "'s", "12", "!!", " ", "日本", "　", "\x1c", "🎉", "\r\n", "²", "."], random.Random(3)
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|> x", "a" * 300 + " " + "ab" * 200, None]
    monkeypatch.setattr(words, "MEMORY", 50)
    monkeypatch.setattr(words, "CHUNK", 2000)
    for x, ids, data in zip(texts, own.encode(texts), fast.of(texts), strict=True):
        x = x or ""
        assert ids.tolist() == t.encode_ordinary(x) and own.decode(ids.tolist()) == x.encode()
        assert data.tolist() == slow.encode(x, add_special_tokens=False).ids


def split(ids, size):
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]


def test_rank_queue():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, r = bpe.Bpe(RANKS, PATTERN), random.Random(6)
    pieces = [bytes(r.choice(letters) for _ in range(r.randint(1, 60))) for letters in (b"ab", b"a", b"the ing", bytes(range(256)), b"0123456789", b" =-_") * 200]
    pieces += [b"a" * 5000, b"ab" * 3000, bytes(r.choice(b"abc") for _ in range(20_000))]
    want = [t._encode_single_piece(p) for p in pieces]
    assert split(*own.merge(pieces)) == want
    assert split(*own.merge._merge(pieces[:30], one_by_one=True)[:2]) == [own.merge._merge([p])[0].tolist() for p in pieces[:30]]
    assert own.merge([])[0].tolist() == []


def test_rank_queue_where_order_matters(tmp_path):
    # merging "bc" makes "abc", of a lower rank, whose own merge decides what becomes of the next "bc"
    tokens = [*[bytes((i,)) for i in range(256)], b"abc", b"abcb", b"bc", b"cb"]
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(x) + b" %d\n" % i for i, x in enumerate(tokens)))
    own = bpe.Bpe(str(tmp_path / "ranks"), PATTERN)
    t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(tokens)}, special_tokens={})
    r = random.Random(2)
    pieces = [b"abcbc", b"abcbcbc"] + [bytes(r.choice(b"abc") for _ in range(r.randint(1, 12))) for _ in range(2000)]
    assert not own.merge._merge(pieces)[2].all()
    assert split(*own.merge(pieces)) == [[own.ranks[p]] if p in own.ranks else t._encode_single_piece(p) for p in pieces]


# op7


def spans_by_hand(t):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(secrets.PATTERNS.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, t) if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets(spark, docs, nothing):
    model = secrets.train(secrets.default_samples(spark))
    extra = ["password: token: abcdefghijklmnop secret=abcdefghijklmnop", "é AKIA" + "Z" * 20 + " password=b7db7aa4a5fcc78305" * 700, "deadbeefdeadbeef", "x aZ3kQ9xLm2Pw8RtY5vB7 user_session_handler_factory getUserSessionHandlerFactory"]
    df = docs.select("doc_id", "text").where("doc_id is not null and doc_id <> 12").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = {r.doc_id: r for r in secrets.report(df, model).collect()}
    for i, t in [(r.doc_id, r.text or "") for r in df.collect()]:
        base = spans_by_hand(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, z, k in base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(b[3] == k for b in base) for k in ("assign", "access", "hex"))
    assert got[103].spans == "random:2:22"
    masked = {r.doc_id: r.text for r in secrets.redact(df, model).collect()}
    assert masked[102] == "[SECRET]" and masked[103].startswith("x [SECRET] user_session") and masked[5] is None and masked[1] == BASE
    assert secrets.report(nothing, model).collect() == []


def test_markov_by_hand(spark):
    """Counts, ratios and the threshold, pair by pair and token by token."""
    samples = [(r.text, r.random) for r in secrets.default_samples(spark, 1500).collect()]
    df = spark.createDataFrame([*samples, (None, True), ("abc", None), ("x", False)], "text string, random boolean")
    model = secrets.train(df)
    held = {r.text for r in df.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(secrets.HELD_OUT)) == 0).collect()}
    place = lambda c: secrets.ALPHABET.find(c) + 1
    n = {True: collections.Counter(), False: collections.Counter()}
    for text, random_ in samples:
        if text not in held:
            n[random_].update((place(a), place(b)) for a, b in zip(text, text[1:]))
    total = {(k, a): sum(n[k][a, b] + 0.5 for b in range(63)) for k in n for a in range(63)}
    ratio = lambda t: sum(math.log((n[True][p, q] + 0.5) / total[True, p]) - math.log((n[False][p, q] + 0.5) / total[False, p]) for p, q in ((place(x), place(y)) for x, y in zip(t, t[1:])))
    tokens = ["aZ3kQ9xLm2Pw8RtY5vB7", "getUserSessionHandlerFactory", "q7Xv2Lp0Zr4K8s", "internationalisation", "zxqjkvbnwpfh", "AbCdEfGhIjKlMnOp", "short1x"]
    rows = spark.createDataFrame([(i, f"some {t} here") for i, t in enumerate(tokens)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.report(rows, model).collect()}
    for i, t in enumerate(tokens):
        assert got[i] == (f"random:5:{5 + len(t)}" if len(t) >= secrets.LEAST_TOKEN and ratio(t) > model.threshold else ""), t
    assert got[0] and not got[1]


def test_markov_on_held_out_documents(spark):
    """Secrets without the patterns' words around them, in documents that the models haven't seen."""
    d = table(spark, "/root/testdata/sf0.01", "documents")
    seen, fresh = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    model = secrets.train(secrets.default_samples(spark, 2000).union(secrets.samples_of(seen)))
    texts = [r.text or "" for r in fresh.collect()]
    tokens = [x for t in texts for x in re.findall(rf"{secrets.TOKEN[:-1]}{{{secrets.LEAST_TOKEN},}}", t) if not spans_by_hand(t)]
    r = random.Random(12)
    alphabet = secrets.ALPHABET
    planted = ["".join(r.choice(alphabet) for _ in range(n)) for n in [16, 20, 32, 40] * 50]
    rows = spark.createDataFrame([(i, t, False) for i, t in enumerate(tokens)] + [(i, t, True) for i, t in enumerate(planted)], "doc_id long, text string, planted boolean")
    share = {r.planted: r.share for r in rows.select("planted", (F.size(secrets._random(F.col("text"), model)) > 0).cast("int").alias("hit")).groupBy("planted").agg(F.avg("hit").alias("share")).collect()}
    assert len(tokens) > 300 and share[True] >= 0.9 and share[False] <= 0.01


# op8


@pytest.mark.parametrize("block", [2048, 20])
def test_near_vectors(vectors, block, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "LEAF", 4)
    rows = [tuple(r)[:3] for r in vectors.collect()]
    got = collections.Counter(tuple(r) for r in covertree.near_vectors(vectors).collect())
    ok = [i for i, (v, e, lab) in enumerate(rows) if v is not None and lab is not None and usable(e)]
    up = {rows[i][0]: rows[i][0] for i in ok}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = collections.Counter()
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                up[b] = a
    want = collections.Counter((v, n[i], root(v), root(v) == v) if i in set(ok) else (v, 0, v, True) for i, (v, _, _) in enumerate(rows))
    assert got == want
    assert covertree.near_vectors(vectors.limit(0)).collect() == []


def test_near_vectors_of_repeated_ids(spark):
    u, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(5, u, 1), (12, u, 1), (12, w, 1), (20, w, 1), (12, w, 2), (3, w, 2), (12, None, 1), (8, w, None)], VECTORS)
    got = collections.Counter(tuple(r) for r in covertree.near_vectors(df).collect())
    assert got == collections.Counter([(5, 1, 3, False), (12, 1, 3, False), (12, 1, 3, False), (20, 1, 3, False), (12, 1, 3, False), (3, 1, 3, True), (8, 0, 8, True), (12, 0, 12, True)])


def test_links_beside_the_threshold():
    """Distances near 0 are known to some 1e-8 only; bounds made of them must not decide such pairs."""
    r = np.random.default_rng(3)
    for _ in range(300):
        a, b = np.linalg.qr(r.standard_normal((3, 2)))[0].T
        turn = lambda t: math.cos(t) * a + math.sin(t) * b  # noqa: E731, B023
        angle = math.acos(0.93)
        x = np.stack([turn(0.0), turn(1e-8 * r.random()), turn(angle + 5e-9 * r.standard_normal()), turn(angle + 3 * r.random())])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        n, _, _ = covertree.links(x, None, np.ones(4, np.int64), None, 0.93)
        assert n.tolist() == [sum(float(np.dot(x[i], x[j])) >= 0.93 for j in range(4) if j != i) for i in range(4)]


# op9


def test_toxicity(spark, sf, docs, nothing):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit(d, labels.where("doc_id % 4 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = toxicity.score(d, model).withColumnRenamed("toxic", "said").join(labels.where("doc_id % 4 = 0"), "doc_id")
    share = {(r.toxic, r.said): r["count"] for r in got.groupBy("toxic", "said").count().collect()}
    assert share.get((0, True), 0) <= 0.02 * share[0, False] and share[1, True] >= 2 * share.get((1, False), 0)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.severity <= 2 and r.toxic is not None for r in out)
    assert toxicity.score(nothing, model).collect() == []
    none = toxicity.fit(nothing, labels)
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())


def test_fit_is_least():
    """No change of a weight or threshold lowers the negative log-likelihood, computed row by row."""
    r = np.random.default_rng(5)
    n, d = 300, 6
    toxic = r.random(n) < 0.4
    hits = np.where(toxic, r.integers(1, 9, n), 0)
    ids = [sorted(set(r.integers(0, 3, 2).tolist() + (r.integers(3, d, 2).tolist() if t and r.random() < 0.8 or r.random() < 0.1 else []))) for t in toxic]
    rows = pd.DataFrame({"toxic": toxic, "ids": ids, "x": [[math.log1p(1 + (i % 3)) for i in x] for x in ids], "hits": hits})
    model = toxicity._regress(rows, [f"f{i}" for i in range(d)])
    w = [model.weights.get(f"f{i}", 0.0) for i in range(d)]
    middle = float(np.median(hits[toxic]))

    def loss(w, t0, t1):
        total = 0.05 * sum(v * v for v in w)
        for bad, own, x, hit in zip(toxic, ids, rows["x"], hits, strict=True):
            s = sum(w[i] * v for i, v in zip(own, x, strict=True))
            above = [1 / (1 + math.exp(t - s)) for t in (t0, t1)]
            total -= math.log((above[1] if hit > middle else above[0] - above[1]) if bad else 1 - above[0])
        return total / n

    best = loss(w, *model.thresholds)
    for i in range(d):
        for step in (0.05, -0.05):
            assert loss([v + step * (i == j) for j, v in enumerate(w)], *model.thresholds) > best
    for a, b in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)):
        assert loss(w, model.thresholds[0] + a, model.thresholds[1] + b) > best


def test_reject_keeps_columns(docs, nothing):
    model = toxicity.Ordinal({"=token": 5.0}, (1.0, 2.0))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter((i, t) for i, t in TEXTS if i != -7)
    assert toxicity.drop_toxic(nothing, model).collect() == []


# op10


def components_by_hand(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset([tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])))
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                up[hi] = lo
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=repr)


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = say(80, 40), say(81, 40), say(82, 40)
    rows = [(5, a), (12, a), (12, b), (20, b), (12, b), (30, c), (30, c + " x"), (None, c), (None, c), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("t", F.lit("x")).repartition(3)
    got = minhash.near_duplicates(df, k=2).collect()
    assert sorted(map(tuple, got), key=repr) == components_by_hand(rows, 2, 80)
    left = collections.Counter((r.doc_id, r.text) for r in minhash.drop_near_duplicates(df, k=2).collect())
    one = [x for x in ((30, c), (30, c + " x")) if left[x]]
    assert len(one) == 1 and left == collections.Counter([*one, (5, a), (12, b), (None, "")])


@pytest.mark.parametrize(("k", "block"), [(2, 256), (5, 3)])
def test_near_duplicates(spark, docs, nothing, k, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(4)
    copies = []
    for i in range(40):  # a group of near copies around the threshold
        w = BASE.split()
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = "z" + str(r.random())
        copies.append((100 + i, " ".join(w)))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(copies, "doc_id long, text string"))
    got = minhash.near_duplicates(df, k=k).collect()
    assert sorted(map(tuple, got), key=repr) == components_by_hand([(r.doc_id, r.text) for r in df.collect()], k, 80)
    if k == 2:
        assert minhash.near_duplicates(nothing).collect() == []


def test_hashing_in_chunks(monkeypatch):
    from cutgrain.llm import shingles as s

    text = say(9, 4000) + " " + "q" * 3000
    whole = word_hashes(text)
    monkeypatch.setattr(s, "CHUNK", 1000)
    s._powers.clear()
    assert (word_hashes(text) == whole).all() and len(whole) == 4001
    s._powers.clear()
    assert len(shingles(whole, 5)) == 3997 and len(shingles(whole[:3], 5)) == 1 and len(shingles(whole[:0], 5)) == 0


def test_toxicity_features_and_scores_by_hand(spark, monkeypatch):
    """What the fit is given, and what a model says, text by text in plain Python."""
    r = random.Random(21)
    rude, plain = ["grubble", "snorkwit", "zounds"], ["kettle", "harbour", "ledger", "meadow", "Ägypten"]
    rows = []
    for i in range(160):
        toxic = i % 4 == 0
        rows.append((i, " ".join(r.choice(plain) for _ in range(r.randint(3, 12))) + (" " + " ".join(r.choice(rude) for _ in range(r.randint(1, 4))) if toxic else ""), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, "no label")], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1)], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "_regress", lambda got, names_: seen.update(rows=got, names=names_) or toxicity.Ordinal({}, (1.0, 2.0)))
    toxicity.fit(docs, labels)
    words_ = {i: collections.Counter(re.findall(r"[^\W\d_]+", t.lower())) for i, t, _ in rows}
    parts = lambda w: {"=" + w} | {f"{n}:{w[:n]}" for n in (4, 5, 6) if len(w) >= n}
    has = {i: {f for w in c for f in parts(w)} for i, c in words_.items()}
    pos, neg = sum(y for *_, y in rows), sum(1 - y for *_, y in rows)
    strong = {}
    for f in set().union(*has.values()):
        p, q = (sum(f in has[i] for i, _, y in rows if y == want) for want in (1, 0))
        part = lambda n, share, both=p + q: n * math.log(n / both / share) if n else 0.0
        g = 2 * (part(p, pos / (pos + neg)) + part(q, neg / (pos + neg)))
        if g >= toxicity.EVIDENCE:
            strong[f] = p / pos > 20 * (q + 0.5) / neg
    assert set(seen["names"]) == set(strong) and any(strong.values())
    want = []
    for i, _, y in rows:
        x = collections.Counter(f for w, n in words_[i].items() for f in parts(w) & set(strong) for _ in range(n))
        hits = sum(n for w, n in words_[i].items() if any(strong.get(f) for f in parts(w)))
        want.append((bool(y), hits, tuple(sorted((f, round(math.log1p(n), 5)) for f, n in x.items()))))
    given = [(bool(g.toxic), g.hits, tuple(sorted((seen["names"][k], round(float(v), 5)) for k, v in zip(g.ids, g.x, strict=True)))) for g in seen["rows"].itertuples()]
    assert sorted(given) == sorted(want)
    model = toxicity.Ordinal({"=grubble": 1.5, "4:snor": 0.75, "=kettle": -0.5}, (1.0, 2.5))
    for g in toxicity.score(docs, model).collect():
        c = words_.get(g.doc_id, {})
        x = sum(w * math.log1p(sum(n for word, n in c.items() if f in parts(word))) for f, w in model.weights.items())
        over = [1 / (1 + math.exp(t - x)) for t in model.thresholds]
        assert (round(g.severity, 9), round(g.p_toxic, 9), g.grade, g.toxic) == (round(sum(over), 9), round(over[0], 9), sum(o >= 0.5 for o in over), over[0] >= toxicity.REJECT)


# the pipeline

CLASHES = "removed late h1 t copy row id rank n score component kept spans start end shingles bands __id __t __u __copy __late __doc __gone __gt __gc __kid __n __row __first __spans `odd name`".split(" ")


def test_stages_keep_all_columns_and_stand_empty_tables(spark, sf):
    names = " ".join(CLASHES).replace("`", "").replace("odd name", "odd-name").split()
    docs = table(spark, sf, "documents").limit(40)
    rows = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    wide = rows.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in names}).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (wide, wide.limit(0)):
            got = stage(spark, df, sf)
            assert got.columns == wide.columns, name
            for r in got.collect():
                assert all(r[c] == f"{c} {r.doc_id}" for c in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf).select("doc_id").distinct().count() == 40


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    cols = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf).cache()
        assert got.columns == cols and got.count() <= docs.count()
        seen.append((name, docs, got))
        docs = got
    named = {name: (a, b) for name, a, b in seen}
    before, after = named["near_dedup"]
    want = {i for i, _, _, kept in components_by_hand([(r.doc_id, r.text) for r in before.collect()], 5, 80) if kept}
    assert {r.doc_id for r in after.collect()} == want
    before, after = named["secret_scan"]
    assert not any(spans_by_hand(r.text or "") for r in after.collect()) and before.count() == after.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.ORACLE_SQL is None
