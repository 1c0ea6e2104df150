"""The ten operators against brute force, public libraries and SQL."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from tapewatch.llm import bpe, embedding_dedup, gray_index, language_id, line_dedup, mixing, pieces, quality_model, quality_rules, queries, rans, sharding, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "s1", 0), (1, None, None, None, None), (2, "", "en", "s1", 0), (None, "a b c d e f", None, "s2", 11), (4, " \n\t ", "de", None, 4), (5, "word " * 9000 + "end", "en", "s3", 45003), (6, "a b c d e f", "fr", "s2", 11), (6, "a b c d e f", "fr", "s2", 11)]


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select * from '{SF}/documents.parquet' order by doc_id").df()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).selectExpr("*", "1 as id", "2 as component", "3 as size", "4 as key", "5 as _score", "6 as tokens", "7 as shard")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def least(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_op1_law(spark, documents):
    got = queries.op1_shards(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(documents.doc_id)
    joined = got.merge(documents, on="doc_id")
    assert (joined["size"] == joined.text.map(lambda t: len((t or "").encode()) + 8)).all()
    assert (joined.text_crc32 == joined.text.map(lambda t: zlib.crc32((t or "").encode()))).all()
    assert joined.groupby("text").shard.nunique().max() == 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    total = got.groupby("shard")["size"].sum()
    assert total.max() <= max(joined.groupby("text")["size"].sum().max(), 1.02 * total.mean())


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    weights = sorted(rng.integers(1, 60, 80).tolist(), reverse=True)
    room, plain = [], []
    for w in weights:
        fit = [(r, i) for i, r in enumerate(room) if r >= w]
        i = min(fit)[1] if fit else len(room)
        room[i:i] = [100] if not fit else []
        room[i] -= w
        plain.append(i)
    count = Counter(weights)
    runs = sharding.pack([(w, n, w * n) for w, n in count.items()], 100)
    filled = Counter()
    for r in runs:
        filled[r.bin] += r.kind * r.count
    expected = Counter()
    for w, i in zip(weights, plain, strict=True):
        expected[i] += w
    assert sorted(filled.values()) == sorted(expected.values()) and max(filled.values()) <= 100


def test_op1_edges(spark, odd, none):
    assert sharding.shard(odd, 24).count() == len(ODD) and sharding.shard(none, 24).count() == 0


@pytest.mark.parametrize(("words", "limit"), [(1, 4), (4, 40)])
def test_gray_index_finds_all(words, limit):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (40, words), dtype=np.uint64)
    x = np.repeat(base, 8, 0)
    for _ in range(3):
        x[np.arange(len(x)), rng.integers(0, words, len(x))] ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    bucket = rng.integers(0, 3, len(x))
    order = gray_index.gray_order(bucket, x)
    x, bucket = x[order], bucket[order]
    got = {(i, j) for a, b in gray_index.linked_pairs(bucket, x, limit) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    expected = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if bucket[i] == bucket[j] and np.bitwise_count(x[i] ^ x[j]).sum() <= limit}
    assert got == expected and len(expected) > 30
    assert gray_index.least_labels(len(x), [tuple(np.array(sorted(expected)).T)]).tolist() == least(len(x), expected)


def plain_print(text):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_op2_equals_brute_force(spark, documents):
    got = queries.op2_simhash_near_dedup(spark, SF).toPandas().sort_values("doc_id")
    prints = [plain_print(t) for t in documents.text]
    assert [int(x, 16) for x in got.fingerprint] == prints and got.fingerprint.str.len().eq(16).all()
    n = len(prints)
    label = least(n, [(i, j) for i in range(n) for j in range(i + 1, n) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert got.component_id.tolist() == [documents.doc_id[k] for k in label]


def test_op2_many_chunks_and_edges(spark, odd, none, documents):
    small = simhash.SimHash(cap=3)
    docs = spark.createDataFrame(documents)
    one = {(r["id"], r["component"]) for r in simhash.near_duplicate_classes(docs, small).collect()}
    two = {(r["id"], r["component"]) for r in simhash.near_duplicate_classes(docs).collect()}
    assert one == two
    got = simhash.near_duplicate_classes(odd).collect()
    assert len(got) == len(ODD) and {r["component"] for r in got if r["id"] in (1, 2, 4)} == {1}
    assert simhash.near_duplicate_classes(none).count() == 0
    assert simhash.drop_near_duplicates(odd, simhash.SimHash()).columns == odd.columns


def test_near_duplicates_keep_rows_of_other_classes(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "red green blue white black")
    rows = [(None, a), (None, b), (7, b + " x"), (7, c), (7, c), (3, a), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _kept", "2 as kept_id", "3 as text_hash", "4 as row", "5 as class", "6 as id")
    got = simhash.drop_near_duplicates(docs, simhash.SimHash(words=2, bits=256, distance=60, differ=0.153, similar=80))
    assert got.columns == docs.columns
    kept = Counter((r[0], r[1]) for r in got.collect())
    assert kept[(3, a)] == 1 and kept[(None, a)] == 0 and kept[(7, c)] == 1 and kept[(9, None)] == 1 and kept[(None, "")] == 0
    assert kept[(7, b + " x")] == 1 and kept[(None, b)] == 0  # five of six pairs are the same: 0.83


def test_masks_grow_with_the_rows():
    for rows in (1_000, 10**7, 10**10):
        found = simhash.masks(corpus_pipeline.NEAR, rows)
        width = len(found[0])
        assert rows / 2**width <= simhash.CAP and 1 - (1 - (1 - 0.153) ** width) ** len(found) >= 0.999
    assert len(simhash.masks(simhash.SimHash(), 10**9)) < 1 << 12


def test_op3_equals_library(spark, documents):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = queries.op3_byte_bpe(spark, SF).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        ids = library.encode_ordinary(text or "")
        row = got.loc[i]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_op3_odd_texts_and_edges(spark, odd, none):
    import random

    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    encoder = bpe.Encoder(ranks, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    memory = pieces.Memory(lambda ps: [encoder.encode(p) for p in ps], "<i4")
    rnd = random.Random(5)
    kinds = [" \n\t\r   '", "abcdeéñß", "'stremvlld_", "0123½²Ⅳ", "中文字日本語", "\U0001f600‍\x1c\x85_-!?", ".,;:!? a"]
    texts = ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.choice([1, 5, 40, 300]))) for _ in range(1500)] + ["a" * 20_000, " " * 9000 + "x", "ab" * 9000]
    wide = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [f"8 {''.join(wide[k : k + 40])}'m {' '.join(wide[k : k + 40])}." for k in range(0, len(wide), 40)]
    for at in range(0, len(texts), 500):
        tokens, sizes = memory.lists(pa.array([*texts[at : at + 500], None]))
        assert tokens.tolist() == [i for t in texts[at : at + 500] for i in library.encode_ordinary(t)] and sizes[-1] == 0
    tokens = bpe.encode(odd, encoder)
    assert [r["bytes"] for r in bpe.decode(tokens, encoder).collect()] == [(r[1] or "").encode() for r in ODD]
    assert bpe.round_trip(none, encoder, keep_tokens=True).count() == 0


def test_op4_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    expected = sorted(con.execute(queries.ORACLES["op4_line_dedup"]).fetchall())
    got = sorted(tuple(r) for r in queries.op4_line_dedup(spark, SF).collect())
    assert got == expected and sum(r[1] for r in got) > 0


def test_op4_edges(spark, odd, none):
    got = line_dedup.drop_boilerplate(odd, sites=2, removed_col="gone")
    assert got.columns == [*odd.columns, "gone"] and got.count() == len(ODD)
    clash = odd.selectExpr("*", "1 as _doc", "2 as _cut", "3 as cut", "4 as row", "5 as row_text", "6 as doc", "7 as pos")
    assert [tuple(r)[5:] for r in line_dedup.drop_boilerplate(clash, sites=2).collect()] == [tuple(r)[5:] for r in clash.collect()]
    assert line_dedup.drop_boilerplate(none).count() == 0
    docs = spark.createDataFrame([(i, f"own {i}\nshared\n\nshared ", "en", f"s{i}", 0) for i in range(4)], DOCS)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(docs, sites=4).collect()}
    assert got == {0: "own 0\nshared\n"} | {i: f"own {i}\n" for i in (1, 2, 3)}


def test_op5_equals_library(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = queries.op5_token_files(spark, SF).toPandas().sort_values("doc_id")
    start, expected = 0, []
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got[["doc_id", "start", "n_tokens", "ids_crc32"]].values.tolist()] == expected


def test_op5_coder(spark, odd, none):
    ids = (np.random.default_rng(1).zipf(1.3, 40_000) % 50_257).astype(np.uint32)
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=50_257)))
    for n in (0, 1, 31, 33, 8192, 8193, 40_000):
        data = coder.frame(np.arange(2), np.array([n, 0]), ids[:n])
        assert (coder.read(data)[2] == ids[:n]).all()
    broken = bytearray(data)
    broken[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.read(bytes(broken))
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokenizer)
    long = spark.createDataFrame([(3, "one <|endoftext|> two", "en", "s", 0), (9, "words of\na text. " * 60_000, "en", "s", 0), (-4, " \n  x\x1f y ", "en", "s", 0)], DOCS)
    for docs, special in ((odd, False), (long, False), (long, True), (none, False)):
        folder = rans.new_folder(spark)
        rans.write_tokens(docs, folder, tokenizer, 2, 50_257, specials_as_text=special)
        library.encode_special_tokens = special
        rows = sorted(((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
        got = rans.read_tokens(spark, folder).orderBy("start").collect()
        assert [r["id"] for r in got] == [r[0] for r in rows] and sorted(np.frombuffer(r["tokens"], "<u4").tolist() for r in got) == sorted(r[1] for r in rows)
        assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_very_long_texts_are_cut_before_blanks(monkeypatch):
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    monkeypatch.setattr(pieces, "SLICE", 500)
    text, memory = "Some words,  and\n more. \n" * 400, rans._memory(tokenizer)
    (_, tokens, sizes), = memory.batches(pa.RecordBatch.from_arrays([pa.array([text])], names=["t"]), 0)
    assert len([*pieces._long(text)]) > 5 and tokens.tolist() == Tokenizer.from_str(tokenizer).encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(tokens)]


def test_op5_frames_follow_rows():
    coder, held = rans.Coder(rans.frequencies(np.ones(300, np.int64))), []
    for shard, rows in ((0, [0, 1, 2]), (1, [0, 1]), (1, [7, 8])):  # a gap and another shard end a frame
        ids = [np.arange(k + 2, dtype="<u2").tobytes() for k in rows]
        held.append(pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), pa.array(rows), pa.array(rows), pa.array(ids)], names=["shard", "row", "id", "ids"]))
    got = [b.to_pylist()[0] for b in rans._frames(iter(held), coder, "<u2")]
    assert [(g["shard"], g["row"]) for g in got] == [(0, 0), (1, 0), (1, 7)]
    assert [coder.read(g["payload"])[0].tolist() for g in got] == [[0, 1, 2], [0, 1], [7, 8]]


def test_op6_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + 0.1 * rng.normal(size=(30, 16)), base[:3], 2 * base[:3]]).tolist()
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] * 16, 0), (204, [1.0], 0), (205, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as node", "3 as cell")
    got = embedding_dedup.near_duplicates(df).toPandas().set_index("id")
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    label = least(len(x), np.argwhere(np.triu(linked, 1)).tolist())
    assert got.loc[range(len(x))].n_links.sum() >= 0.9 * (linked.sum() - len(x))
    assert (got.loc[range(len(x))].component_id == label).mean() >= 0.9 and (got.loc[200:].n_links == 0).all() and got.loc[200:].kept.all()
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["double", "float"])
def test_op6_recall_over_many_cells(spark, kind, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(1500, 48)), 4, 0)
    x = (x + 0.25 * rng.normal(size=x.shape)).astype(np.float32 if kind == "float" else float)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    asked = []
    monkeypatch.setattr(embedding_dedup, "_visits", lambda *a, f=embedding_dedup._visits: asked.append((len(a[1][0]) * len(a[1][1]), f(*a))) or asked[-1][1])
    got = embedding_dedup.near_duplicates(df).toPandas().sort_values("id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    assert asked[0][0] >= 81 and asked[0][1] < asked[0][0] / 3  # several cells, of which few are visited
    assert (got.n_links.to_numpy() <= linked.sum(1)).all() and got.n_links.sum() >= 0.95 * linked.sum() > 4000
    label = np.array(least(len(x), np.argwhere(np.triu(linked, 1)).tolist()))
    assert (got.component_id.to_numpy() == label).mean() >= 0.95 and (got.kept == (got.id == got.component_id)).all()


def test_op6_recall_on_clusters():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(300, 64)), 4, 0)
    x += 0.2 * rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = (embedding_dedup.codebook(x[:, :32], 12), embedding_dedup.codebook(x[:, 32:], 12))
    visits = embedding_dedup._visits(x, books, 0.9, 0.99)
    cells, home = embedding_dedup.nearest_cells(x, books, visits), embedding_dedup.nearest_cells(x, books, 1)[:, 0]
    pairs = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    assert np.mean([home[j] in cells[i] for i, j in pairs]) >= 0.95
    full = embedding_dedup._apart(x[:5, :32], books[0])[:, :, None] + embedding_dedup._apart(x[:5, 32:], books[1])[:, None]
    assert (np.sort(full.reshape(5, -1), 1)[:, :visits] == pytest.approx(np.take_along_axis(full.reshape(5, -1), cells[:5], 1)))


def plain_budgets(supply, mix, total):
    """Tokens of each leaf: children that can't hold their share are filled, and the rest is dealt again."""
    room = Counter()
    children = {}
    for leaf, tokens in supply.items():
        for k in range(len(leaf) + 1):
            room[leaf[:k]] += tokens * mix.epochs
            if k:
                children.setdefault(leaf[: k - 1], set()).add(leaf[:k])
    out = {}

    def deal(node, amount):
        if node not in children:
            out[node] = amount
            return
        left, open_, got = amount, set(children[node]), {}
        while open_:
            weight = sum(mix.weights.get(c, 1.0) for c in open_)
            share = {c: left * mix.weights.get(c, 1.0) / weight if weight else left / len(open_) for c in open_}
            full = {c for c in open_ if share[c] >= room[c]} if weight == 0 else {c for c in open_ if share[c] >= room[c] and mix.weights.get(c, 1.0) > 0}
            if not full:
                got |= share
                break
            got |= {c: room[c] for c in full}
            left -= sum(room[c] for c in full)
            open_ -= full
        for c, x in got.items():
            deal(c, max(0.0, round(x, 6)))

    deal((), min(total, room[()]))
    return out


def plain_mix(rows, mix):
    """(id, epoch) by sorting each leaf."""
    supply = Counter()
    for _, leaf, t in rows:
        supply[leaf] += t
    plan, out = plain_budgets(supply, mix, mix.share * sum(supply.values())), set()
    for leaf, budget in plan.items():
        own = [r for r in rows if r[1] == leaf]
        whole = min(mix.epochs, int(budget // supply[leaf])) if supply[leaf] else mix.epochs
        out |= {(i, e) for i, _, _ in own for e in range(whole)}
        rest = budget - whole * supply[leaf] if whole < mix.epochs else 0
        run = 0
        for i, _, t in sorted(own, key=lambda r: hashlib.md5(f"{mix.seed}|{whole}|{r[0]}".encode()).hexdigest()):
            if run < rest:
                out.add((i, whole))
            run += t
    return out


def test_op7_equals_plain(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "lang", "source", queries.domain().alias("domain"), queries.estimated_tokens().alias("tokens")).collect()
    rows = [(r["doc_id"], (r["domain"], r["lang"], r["source"]), r["tokens"]) for r in docs]
    got = {(r["doc_id"], r["epoch"]) for r in queries.op7_source_mix(spark, SF).collect()}
    assert got == plain_mix(rows, queries.mix(share=0.8, epochs=2)) and len(got) > 20


def dealt(spark, supply, mix, total):
    leaves = spark.createDataFrame([(*k, v) for k, v in supply.items()], ", ".join(f"`{c}` string" for c in mix.levels) + ", supply long")
    return {tuple(r[c] for c in mix.levels): r["budget"] for r in mixing.budgets(leaves, mix, total).collect()}


def test_op7_shortage_goes_to_siblings_first(spark, odd, none):
    mix = mixing.Mix(("d", "l"))
    got = dealt(spark, {("a", "x"): 10, ("a", "y"): 500, ("b", "x"): 500, ("b", "y"): 500}, mix, 400)
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    got = dealt(spark, {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 500, ("b", "y"): 500}, mix, 400)
    assert got == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 185, ("b", "y"): 185}
    got = [(r["id"], r["lang"], r["source"]) for r in mixing.select(odd, mixing.Mix(("lang", "source")), "doc_id", "n_chars").collect()]
    assert sorted(got, key=str) == sorted(((r[0], r[2], r[3]) for r in ODD), key=str)  # all of them: the share is 1
    assert mixing.select(none, mixing.Mix(("lang", "source")), "doc_id", "n_chars").count() == 0
    odd = odd.selectExpr("*", "7 as _id", "8 as taken_id", "'x' as domain", "9 as row", "1 as leaf")
    kept = mixing.keep_selected(odd, mixing.Mix(("a",), {("en",): 0.0}, share=0.0005), "doc_id", mixing.F.col("n_chars"), {"a": mixing.F.col("lang")})
    assert kept.columns == odd.columns and 0 < kept.count() < len(ODD)


def test_op7_random_trees_and_many_leaves(spark):
    rng = np.random.default_rng(3)
    mix = mixing.Mix(("a", "b", "c"), {("1",): 0.0, ("2",): 3.0, ("2", "0"): 0.0, ("0", "1"): 5.0, (None,): 2.0, (None, "1"): 0.0}, epochs=2)
    supply = {(a, b, str(c)): int(rng.integers(0, 900)) for a in (None, "", "0", "1", "2") for b in ("0", "1", None) for c in range(int(rng.integers(1, 9)))}
    for share in (0.1, 0.5, 0.9, 1.9, 5.0):
        total = share * sum(supply.values())
        got, plain = dealt(spark, supply, mix, total), plain_budgets(supply, mix, total)
        assert got.keys() == plain.keys() and [got[k] for k in plain] == pytest.approx([plain[k] for k in plain], abs=1e-4)
    many = spark.range(150_000).selectExpr("id as doc_id", "cast(id as string) as host", "1 as tokens")
    assert mixing.select(many, mixing.Mix(("host",), share=0.5), "doc_id", "tokens").count() == 150_000  # half a token each


def test_op8_accuracy_and_edges(spark, documents, odd, none):
    got = queries.op8_language_id(spark, SF).toPandas().merge(documents, on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all() and len(held) > 20
    assert (held.lang == held.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()
    model = language_id.learn(spark.createDataFrame(documents))
    assert [r["lang_pred"] for r in language_id.identify(odd, model).collect()][:3] == ["und"] * 3
    told = language_id.told(odd, model, language_id.F.lit(True))
    assert told.columns == ["row", "lang", "score", "known", "learned"] and told.select("row.*").collect() == odd.collect()
    assert language_id.identify(none, language_id.learn(none)).count() == 0


def test_op9_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df()
    got = queries.op9_quality_model(spark, sf).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([(good > b).mean() for b in bad]) >= 0.95
    model = quality_model.learn(none, spark.createDataFrame(labels), train_on=quality_model.F.lit(True))
    assert quality_model.score(odd, model).count() == len(ODD) and not model.weights.any()


def plain_statistics(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if n[x] > 1 for d in range(5)}
    return len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_op10_equals_brute_force(spark, documents, odd, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = queries.op10_quality_rules(spark, SF).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        assert tuple(got.loc[i][names]) == plain_statistics(text)
    assert (got.base_failed == ((got.n_words < 10) | (100 * got.n_repeat_words > 20 * got.n_words))).all() and not (got.kept & got.base_failed).any()
    rows = quality_rules.statistics(odd).collect()
    assert [tuple(r[n] for n in names) for r in rows] == [plain_statistics(r[1]) for r in ODD]
    assert quality_rules.learn_rules(quality_rules.statistics(none), none.selectExpr("doc_id", "1 as quality")) == []


def test_op10_learns_a_conjunction(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 100, 500, int(rng.integers(0, 40)), 0, int(rng.integers(0, 20))) for i in range(3000)]
    labels = [(r[0], 0 if r[3] > 20 and r[5] > 10 else 1) for r in rows]
    s = spark.createDataFrame(rows, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    rules = quality_rules.learn_rules(s, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r["id"]: r["kept"] for r in quality_rules.apply_rules(s, rules).collect()}
    assert rules and np.mean([kept[i] == bool(q) for i, q in labels]) >= 0.95


def test_op10_order_of_the_list_decides(spark):
    """Bad rows lie inside a region that is good but for them, and outside it: a rule that keeps must come before one that drops."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(6000):
        symbols, repeat = int(rng.integers(0, 100)), int(rng.integers(0, 20))
        rows.append((i, 100, 500, symbols, 0, repeat))
        labels.append((i, 0 if symbols > 80 and repeat > 10 or (40 < symbols <= 60 and repeat <= 10 and rng.random() < 0.99) else 1))
    s = spark.createDataFrame(rows, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    rules = quality_rules.learn_rules(s, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r["id"]: r["kept"] for r in quality_rules.apply_rules(s, rules).collect()}

    def plain(row):
        ratio = {"n_words": row[1], "word_length": row[2] / row[1], "symbols_per_word": row[3] / row[1], "dup_lines_per_word": row[4] / row[1], "dup_lines": row[4], "repeat_share": row[5] / row[1]}
        return next((r.keep for r in rules if all((ratio[t.measure] > t.value) == t.above for t in r.tests)), True)

    assert all(kept[r[0]] == plain(r) for r in rows) and np.mean([kept[i] == bool(q) for i, q in labels]) >= 0.93


def test_op1_heavy_groups_are_packed_by_their_bytes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(n) + str(i)) for i, n in enumerate(rng.integers(2_100, 40_000, 400))]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 7).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 7 and loads.max() - loads.min() <= 0.002 * loads.mean()
    weights = Counter(len(t) + 8 for _, t in rows)
    runs = sharding.pack([(w, n, w * n) for w, n in weights.items()], 300_000)
    filled = Counter()
    for r in runs:
        filled[r.bin] += r.kind * r.count
    assert max(filled.values()) <= 300_000 and sum(filled.values()) == sum(w * n for w, n in weights.items())


def test_op9_scores_are_likelihoods(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(3000):
        bad = rng.random() < 0.1
        rows.append((i, " ".join(rng.choice(["junk", "spam", "buy"] if bad and rng.random() < 0.8 else ["calm", "text", "word"], 12))))
        labels.append((i, 0 if bad else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_model.learn(docs, marks, train_on=quality_model.F.col("id") % 2 == 0)
    got = quality_model.score(docs, model).toPandas().set_index("id").score
    held = [i for i in range(3000) if i % 2]
    assert abs(got.loc[held].mean() - np.mean([labels[i][1] for i in held])) <= 0.04
    few = quality_model.learn(docs, marks, train_on=quality_model.F.lit(True), most_bytes=20_000)
    assert few.weights.any()


def test_pipeline(spark, documents):
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert stages == ["language", "lines", "near_duplicates", "mix", "tokens"]
    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.staged(stage(spark, docs, SF), name)
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            assert docs.count() >= 0.98 * before.count()
        if name == "lines":
            assert docs.count() == before.count()
        if name == "near_duplicates":
            kept = {r["doc_id"] for r in docs.collect()}
            shingles = {r["doc_id"]: shingled(r["text"]) for r in before.collect()}
            ids = sorted(shingles)
            near = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if jaccard(shingles[i], shingles[j]) >= 0.8]
            assert near and sum(i in kept and j in kept for i, j in near) <= 0.1 * len(near)
            alone = set(ids) - {i for k, i in enumerate(ids) for j in ids if i != j and jaccard(shingles[i], shingles[j]) >= 0.4}
            assert alone <= kept
    assert docs.where("tokens is null or size(tokens) <> n_tokens").isEmpty()


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_pipeline_takes_odd_rows(spark):
    docs = spark.createDataFrame(ODD * 2, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
    assert docs.count() <= len(ODD) * 2


def test_staged_tables_are_shared(spark):
    assert os.path.isdir(spark.conf.get("spark.checkpoint.dir"))


def texts_at(rng, same, own, name):
    """Two texts of ``same`` common and ``own`` own five-word shingles each, all distinct."""
    words = [f"{name}w{k}" for k in rng.permutation(10_000)[: same + 4]]
    return [" ".join(words + [f"{name}{side}{k}" for k in range(own)]) for side in "ab"]


def test_near_duplicates_are_compared_by_shingles(spark):
    rng = np.random.default_rng(8)
    rows, clean, near = [], [], []
    for k in range(40):
        for same, own, to in ((160, 20, near), (140, 30, clean), (120, 40, clean)):  # Jaccard 0.8, 0.7, 0.6
            a, b = texts_at(rng, same, own, f"p{k}s{same}")
            assert jaccard(shingled(a), shingled(b)) == pytest.approx(same / (same + 2 * own))
            to.append((len(rows), len(rows) + 1))
            rows += [(len(rows), a, "en", "s1", 0), (len(rows) + 1, b, "en", "s1", 0)]
    passage = " ".join(f"common{k}" for k in range(50))
    for k in range(20):
        rows.append((len(rows), " ".join([f"own{k}x{j}" for j in range(100)] + [passage] * 5), "en", "s1", 0))
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert sum(i in kept and j in kept for i, j in near) <= 1 and all(i in kept for i, _ in near)
    assert all(i in kept and j in kept for i, j in clean)
    assert set(range(len(rows) - 20, len(rows))) <= kept


def test_similar_stars_equal_brute_force():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (12, 60), dtype=np.uint64)
    sets = [np.unique(np.concatenate([b[rng.random(60) < 0.93], rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for b in base for _ in range(9)]
    n, node = len(sets), np.arange(len(sets))
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    got = [(b, a) for x, y in simhash._similar_stars(node, sets, 80) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert least(n, got) == least(n, pairs) and 12 < len(set(least(n, pairs))) < n


def test_op8_counts_of_every_language(spark):
    rows = [(1, "gemein gemein gemein haus haus haus baum baum", "de", "s1", 0), (2, "the the the the of of of and and and gemein gemein house", "en", "s1", 0), (3, "uno dos tres cuatro cinco", "es", "s1", 0)]
    model = language_id.learn(spark.createDataFrame(rows, DOCS), known_share=0.2, gram_share=0.05)
    names, at = model.words.names(), {x: k for k, x in enumerate(model.languages)}
    logs = dict(zip(names, model.words.logs, strict=True))
    assert set(names) == {"gemein", "haus", "baum", "the", "of", "and", *"uno dos tres cuatro cinco".split()} - {"house"} and "house" not in names
    assert logs["gemein"][at["en"]] == pytest.approx(np.log(2 / 13.5)) and logs["gemein"][at["es"]] == pytest.approx(np.log(0.5 / 5.5))
    for length, table in model.grams.items():
        shown = Counter()
        for _, text, lang, *_ in rows:
            for w in text.split():
                shown.update((lang, f" {w} "[i : i + length]) for i in range(len(w) + 3 - length))
        total = {x: sum(n for (lang, _), n in shown.items() if lang == x) for x in at}
        for gram, log in zip(table.names(), table.logs, strict=True):
            assert log.tolist() == pytest.approx([np.log((shown[x, gram] or 0.5) / (total[x] + 0.5)) for x in model.languages])


def test_op8_letters():
    assert language_id.letters("½ ² ₃ Ⅳ _9-!") == [] and language_id.letters("हिन्दी Über½x naïve") == ["हिन्दी", "über", "x", "naïve"]
    import unicodedata

    for c in map(chr, range(0x300)):
        low = c.lower()
        expected = [low] if unicodedata.category(low[0])[0] == "L" else []
        assert language_id.letters(c) == expected or len(low) > 1, hex(ord(c))


def test_op8_equals_plain_scoring(spark, documents):
    model = language_id.learn(spark.createDataFrame(documents))
    words = dict(zip(model.words.names(), model.words.logs.astype(float), strict=True))
    grams = {k: dict(zip(t.names(), t.logs.astype(float), strict=True)) for k, t in model.grams.items()}

    def logs(word):
        if word in words:
            return words[word]
        for k in (4, 3, 2, 1):
            padded = f" {word} "
            if known := [grams[k][g] for i in range(max(1, len(padded) - k + 1)) if (g := padded[i : i + k]) in grams[k]]:
                return np.mean(known, 0)
        return np.zeros(len(model.languages))

    texts = [*documents.text[:60], "zzqx unheard wörds", "½ ²", "x"]
    got = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        found = language_id.letters(texts[r["id"]] or "")
        if not found:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        total = sum(logs(w) for w in found)
        share = np.exp(total - total.max())
        assert r["lang_pred"] == model.languages[int(np.argmax(total))] and r["score"] == pytest.approx(share.max() / share.sum(), abs=1e-4)


def test_pipeline_rejects_unknown_languages(spark):
    rng = np.random.default_rng(5)

    def word():
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 9))))

    def said(vocabulary, n):
        return [" ".join(rng.choice(vocabulary, 80)) for _ in range(n)]

    en, de, other = ([word() for _ in range(300)] for _ in range(3))
    rows = [(k, x, "en" if k < 60 else "de", "s1", len(x)) for k, x in enumerate(said(en, 60) + said(de, 60))]
    rows += [(1000 + k, x, None, "s1", len(x)) for k, x in enumerate([" ".join(word() for _ in range(80)) for _ in range(10)] + said(other, 10))]
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    assert max(kept) < 1000 and len(kept) >= 0.98 * 120
    single = [r for r in rows if r[2] == "en"]
    assert corpus_pipeline.language(spark, spark.createDataFrame(single, DOCS), SF).count() >= 0.98 * 60
