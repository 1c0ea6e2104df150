"""Sequence packing, collocations and conversation repair against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from tapewatch.llm import collocations, conversation_repair, queries, sequence_packing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
LONG = "Ää word, x's 12 it's! " * 50_000
ODD = [(1, None, "en"), (1, None, None), (2, "", "en"), (None, "a b c d e f", None), (4, " \n\t ", "de"), (5, LONG, "en"), (6, "a b c d e f", "fr"), (6, "a b c d e f", "fr"), (7, "<|endoftext|>Á Å Σς x\x1cy  z", "fr")]


def same(spark, name, tables):
    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    plain = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want) and len(got)


# packing


@pytest.fixture(scope="module")
def tokenizer():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def plain_place(lengths, capacity):
    """Tries each open gap and a new sequence, and counts all squares anew."""
    gaps, out = [], []
    for s in lengths:
        best = None
        for g in sorted({g for g in gaps if g >= s} | {capacity}):
            count = Counter(x for x in gaps if 0 < x < capacity)
            if g < capacity:
                count[g] -= 1
            if g > s:
                count[g - s] += 1
            score = sum(n * n for n in count.values())
            if best is None or score < best[0]:
                best = score, g
        g = best[1]
        if g < capacity:
            gaps.remove(g)
        gaps.append(g - s)
        out.append(capacity - g)
    return out, len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_placing_takes_the_least_sum_of_squares(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 12) for _ in range(120)]
    sequences, offsets = sequence_packing.place(np.array(lengths), 12)
    want, many = plain_place(lengths, 12)
    assert offsets.tolist() == want and sequences.max() + 1 == many
    assert np.bincount(sequences, lengths).max() <= 12


def lawful(d, capacity):
    for _, r in d.groupby("sequence_id"):
        r = r.sort_values("offset")
        assert r.offset.tolist() == [0, *np.cumsum(r.length)[:-1]] and r.length.sum() <= capacity


def test_documents_are_packed_whole(spark, tokenizer):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD, DOCS).selectExpr("*", "1 as key", "2 as length", "3 as piece", "4 as id", "5 as _chunk")
    own = Tokenizer.from_str(tokenizer)
    ids = Counter()
    for doc_id, text, *_ in docs.collect():
        found = own.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(found), 4096):
            part = found[at : at + 4096]
            ids[doc_id, at // 4096, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = sequence_packing.pack_documents(docs, tokenizer, 1, keep_tokens=True)
    d = got.toPandas()
    plain = lambda x: None if x != x else int(x)
    assert Counter((plain(r.id), r.piece, r.start, r.length, r.ids_crc32) for r in d.itertuples()) == ids
    assert all(zlib.crc32(r.tokens) == r.ids_crc32 and len(r.tokens) == 4 * r.length for r in d.itertuples())
    lawful(d, 4096)
    assert d.sequence_id.nunique() <= -(-d.length.sum() // 4096) * 1.05 + 1
    one = sequence_packing.sequences(got).toPandas()
    assert one.n_tokens.sum() == d.length.sum() and all(len(r.ids) == 4 * r.n_tokens for r in one.itertuples())


def test_chunks_are_packed_again(spark):
    rows = spark.range(20_000).selectExpr("id as key", "1 + abs(xxhash64(id)) % 700 as length", "id as offset2")
    d = sequence_packing.pack(rows, 1000, chunk=1500).toPandas()
    lawful(d, 1000)
    assert sorted(d.key) == list(range(20_000)) and d.sequence_id.nunique() <= d.length.sum() / 1000 * 1.01 + 1
    large = sequence_packing.pack(rows.selectExpr("key", "600 as length"), 1000, chunk=1500).toPandas()
    assert large.sequence_id.nunique() == 20_000


def test_packing_of_nothing(spark, tokenizer):
    none = spark.createDataFrame([], DOCS)
    assert sequence_packing.pack_documents(none, tokenizer, 1).count() == 0


# collocations


def plain_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {x: a for x, a in f.items() if a >= least}
    out = []
    for lang in n:
        mine = []
        for (own, w), a in found.items():
            if own != lang or len(w) < 2:
                continue
            if any(len(v) > len(w) and o == lang and 100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (o, v), b in found.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            mine.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(mine)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "mass"), [(0, collocations.MASS), (1, 300), (2, 40)])
def test_phrases_equal_a_plain_count(spark, seed, mass):
    r = random.Random(seed)
    words = ["a", "b", "A", "é", "É", "x y", "c'", "日本", "z"]
    rows = [("".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "."]) for _ in range(r.randint(0, 60))), r.choice(["en", "fr", None, "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", "de"), (" \t", "fr"), ("a b " * 20_000, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as phrase", "2 as size", "3 as f", "4 as a").repartition(3)
    got = collocations.collocations(docs, least=12, top=25, mass=mass).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 12, 25)


def test_phrases_equal_sql(spark):
    same(spark, "op12_collocations", ["documents"])


def test_summary_keeps_all_that_are_frequent():
    r = np.random.default_rng(3)
    stream = np.concatenate([r.integers(0, 50_000, 40_000), np.repeat(r.integers(0, 50_000, 100), 30)])
    r.shuffle(stream)
    kept = collocations.Summary(len(stream) // 30 + 1)
    for part in np.array_split(stream, 40):
        kept.merge(*np.unique(part, return_counts=True))
        assert len(kept.keys) <= kept.capacity
    keys, counts = np.unique(stream, return_counts=True)
    assert 0 < kept.less < 30 and set(keys[counts >= 30]) <= set(kept.survivors(30)) and len(kept.survivors(30)) < len(keys) / 4
    keys = np.array([0, 5, 6, 1 << 27], np.int64)
    back = collocations._unzipped(collocations._zipped(keys, np.array([1, 70_000, 2, 1])))
    assert back[0].tolist() == keys.tolist() and back[1].tolist() == [1, 70_000, 2, 1]


def test_phrases_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


# conversations


def plain_repair(rows):
    """(cost, audit, repaired lines) by trying all edits row by row, with whole audits in the table."""
    moves = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    names = {"u": "user", "a": "assistant"}

    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for x, (c, e, said) in list(out.items()):
                for role in "ua":
                    if x in moves[role]:
                        new = (c + 5, e + "I", [*said, f"{names[role]}:"])
                        to = moves[role][x]
                        out[to] = min(out.get(to, new), new, key=lambda t: t[:2])
        return out

    table = {0: (0, "", [])}
    for role, text, fault in rows:
        new = {}

        def put(to, found):
            new[to] = min(new.get(to, found), found, key=lambda t: t[:2])  # noqa: B023

        for x, (c, e, said) in inserted(table).items():
            put(x, (c + 2, e + "D", said))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if x in moves.get(role[:1], {}):
                    put(moves[role[:1]][x], (c + extra, e + "K", [*said, f"{role}:{text}"]))
                for to in "ua":
                    if x in moves[to]:
                        put(moves[to][x], (c + 1 + extra, e + "R", [*said, f"{names[to]}:{text}"]))
        table = new
    return min((v for x, v in inserted(table).items() if x in (0, 3)), key=lambda t: t[:2])


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub("[ \x09-\x0d]+$", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(turned):
    """``turned``: (turn, role, text) in order."""
    marked = plain_faults([r[1:] for r in turned])
    cost, audit, said = plain_repair(marked)
    turns = [t for t, *_ in turned if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = Counter(f for *_, f in marked)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turned, turned[1:]))
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha")
RAW = "conv long, turn long, role string, text string, copy int"


def conversation(r, n):
    roles, texts = ["user", "assistant", "system", "tool", " ", "a", ""], ["hi.", "no", "Yes! ", " \t\n", "", "ok? ", "x:y.", " "]
    turns = sorted(r.sample(range(3 * n), n))
    return [(t, r.choice(roles[: r.randint(2, 7)]), r.choice(texts) if r.random() < 0.5 else f"text {r.random()}.") for t in turns]


@pytest.mark.parametrize("size", [1 << 23, 400])
def test_repair_equals_a_plain_version(spark, size):
    r = random.Random(5)
    talks = {c: conversation(r, r.randint(1, 14)) for c in range(60)} | {None: conversation(r, 8), 900: conversation(r, 1500), -5: [(1, "user", "x" * 3_000_000 + ".")], 901: [(None, "user", "one."), (4, "assistant", "two."), (1 << 62, "user", "three.")]}
    rows = spark.createDataFrame([(c, *x, 0) for c, t in talks.items() for x in t], RAW)
    convs = spark.createDataFrame([(c,) for c in talks] + [(777,)], "conv long")
    got = {x.conv: tuple(x[f] for f in FIELDS) for x in conversation_repair.repair(rows, convs, partition_bytes=size).collect()}
    assert got == {c: expected(t) for c, t in talks.items()} | {777: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_of_a_conversation_in_many_ranges(spark):
    """Rows that repeat without end, and equal turns, are spread over tasks too."""
    rows = spark.range(30_000).selectExpr("cast(1 as long) as conv", "cast(7 as long) as turn", "'user' as role", "'again and again.' as text", "0 as copy")
    got = conversation_repair.repair(rows, rows.select("conv"), partition_bytes=20_000).first()
    assert (got["duplicate"], got["illegal"], got["gaps"], got["cost"]) == (29_999, 29_999, 0, 2 * 29_999 + 2) and got["audit"] == "D" * 30_000


def test_conversations_equal_sql(spark):
    same(spark, "op13_conversation_repair", ["conversations"])


def test_damage(spark):
    given = [(c, t, "assistant", f"Some. text! {t}?") for c in (None, 1, 2) for t in [None, *range(40)]] + [(3, 1, None, None)]
    got = conversation_repair.damaged(spark.createDataFrame(given, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as copy", "2 as fate"))
    want = []
    for c, t, role, text in given:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            one = (c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            want += [(*one, k) for k in range(2 if fate == 3 else 1)]
    assert Counter(map(tuple, got.select("conv", "turn", "role", "text", "copy").collect())) == Counter(want)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], RAW)
    assert conversation_repair.repair(none, none.select("conv")).count() == 0
