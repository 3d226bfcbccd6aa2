"""The operators of textmap.llm on small tables: brute force, round trips, odd rows."""

import io
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmap.llm import annsearch, brown, catalog, langid, mixing, neardup, neargraph, pieces, quality, sharding, tokenbin, workers
from textmap.llm.components import components
from textmap.session import stage

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, score string"
LONG = " ".join(f"long{i % 977}x{i}" for i in range(20_000))
ODD = [
    (1, "the cat sat on the mat and looked at the big dog", "en", "a"), (2, None, None, None), (3, "", "en", ""),
    (4, "the cat sat on the mat and looked at the big dog", "en", "a"), (4, "the cat sat on the mat", "de", "b"),
    (None, "one two three", "en", "b"), (7, " \t\n ", "fr", "ä"), (8, LONG, "de", "a"), (9, LONG + " tail", "de", None),
    (10, "ONE Two three", "fr", "b"), (11, "42 17 --", "fr", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, 0, 5, "x", "y") for i, t, lang, s in ODD]
    return stage(spark.createDataFrame(rows, DOCS), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return stage(spark.createDataFrame([], DOCS), "none")


def sizes_of(texts):
    return [len((t or "").encode().split()) for t in texts]


def test_components_brute_force(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(900 + i, 901 + i) for i in range(60)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert found == {x: root(x) for a, b in pairs if a != b for x in (a, b)}


def test_shards(spark, odd, none, small):
    rows = sharding.shard_by_bytes(odd, 3).collect()
    assert len(rows) == len(ODD)
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 16 for _, t, _, _ in ODD)
    assert sharding.shard_by_bytes(none, 40).count() == 0
    rows = catalog.op5_byte_shards(spark, small).orderBy("doc_id").collect()
    total, before, slots = sum(r["size"] for r in rows), 0, Counter()
    for r in rows:
        assert r["shard"] == (2 * before + r["size"]) * 40 // (2 * total) and r["slot"] == slots[r["shard"]]
        before += r["size"]
        slots[r["shard"]] += 1


def test_mix(spark, odd, none, small):
    rows = mixing.mix(odd).collect()
    assert sorted(r["size"] for r in rows) == sorted(sizes_of(t for _, t, _, _ in ODD))
    assert all(0 <= r["copies"] <= 2 for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    rows = catalog.op4_entropy_balancing(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source").toPandas()
    per = rows.merge(docs).groupby("source").agg(
        size=("size", "sum"), known=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")
    ).sort_index()
    assert (per["size"] == per.known).all() and (rows.taken <= 2 * rows["size"]).all()
    weights = np.resize([5.0, 2.0, 1.0], len(per))
    total, full = 1.5 * per.known.sum(), np.zeros(len(per), bool)
    limit = 2.0 * per.known.to_numpy()
    while True:
        level = (total - limit[full].sum()) / weights[~full].sum()
        more = ~full & (weights * level > limit)
        if not more.any():
            break
        full |= more
    assert np.allclose(per.target, np.where(full, limit, weights * level))
    assert (abs(per.taken - per.target) <= 0.02 * per.target + 5).all()
    again = catalog.op4_entropy_balancing(spark, small).toPandas()
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    best = [i for i, _ in rows]
    changed = True
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(x for x in (best[a], best[b]) if x is not None)
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return [len(s) for s in sets], best


def test_near_duplicates(spark, odd, none):
    assert neardup.near_duplicates(none).count() == 0
    found = sorted(map(str, neardup.near_duplicates(odd).select("n_shingles", "component_id").collect()))
    n, best = brute_groups([(i, t) for i, t, _, _ in ODD])
    assert found == sorted(f"Row(n_shingles={a}, component_id={b})" for a, b in zip(n, best, strict=True))
    assert neardup.without_near_duplicates(odd).where("doc_id is null").count() == 1


def test_near_duplicates_in_a_crowd(spark, monkeypatch):
    """A cluster whose members are near one another, some within the limit."""
    monkeypatch.setattr(neardup, "CROWD", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(1, 6)), replace=False):
            words[at] = f"n{rng.integers(0, 40)}"
        rows.append((1000 - i, " ".join(words)))
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string"), "crowd")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert found == dict(zip([i for i, _ in rows], brute_groups(rows)[1], strict=True))


def test_sketch_fills_every_coordinate():
    sets = [neardup.mixed64(np.arange(n, dtype=np.uint64) + np.uint64(7)) for n in (1, 2, 30, 5000)]
    rows = neardup.sketch(sets)
    assert rows.shape == (4, neardup.COORDINATES) and (rows != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    half = neardup.sketch([neardup.mixed64(np.arange(a, a + 1000, dtype=np.uint64)) for a in (0, 500)])
    assert abs((half[0] == half[1]).mean() - 1 / 3) < 0.12


def test_pfor_round_trip():
    rng = np.random.default_rng(2)
    for values in ([0], [2**32 - 1, 0], rng.integers(0, 50_000, 3000), (rng.pareto(1, 5000) * 20).clip(0, 2**32 - 1), [7] * 600):
        values = np.array(values, dtype=np.uint64).astype("<u4")
        stream, kept = io.BytesIO(), []
        stream.close = lambda s=stream, k=kept: k.append(s.getvalue())
        writer = tokenbin.PforWriter(stream)
        cut = len(values) // 3
        for doc, part in ((None, values[:cut]), (-5, values[cut:cut]), (9, values[cut:])):
            writer.add(doc, part.tobytes())
        writer.close()
        source = io.BytesIO(kept[0])
        source.size = lambda n=len(kept[0]): n
        read = list(tokenbin.read_documents(source))
        assert [d for d, _ in read] == [None, -5, 9]
        assert np.array_equal(np.concatenate([x for _, x in read]), values)


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(catalog.TOKENIZER)
    assert tokenbin.read_token_files(tokenbin.write_token_files(none, path)).count() == 0
    found = tokenbin.read_token_files(tokenbin.write_token_files(odd, path)).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    expected = Counter(
        (i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t, _, _ in ODD
    )
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in found) == expected
    ids = [r["doc_id"] for r in found]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r["start"] for r in found] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in found])[:-1]]).tolist()


def test_pieces(spark, odd, none):
    model = public_tokenizers.path(catalog.PIECE_MODEL)
    assert pieces.encode(none, model).count() == 0
    for head in (None, 1):
        found = pieces.encode(odd, model, head=head).collect()
        assert Counter((r["doc_id"], r["decoded"]) for r in found) == Counter((i, t) for i, t, _, _ in ODD)
    table = pieces.Pieces(model)
    value = {p: s for p, _, s in table.rows}
    names = {i: p for p, i, _ in table.rows}
    rows = spark.createDataFrame([(" representation", 1), (" Thndtiones", 1), ("日x", 1), (" a", 1)], "word string, n long")
    for r in pieces.segment(rows, table).collect():
        word = r["word"].replace(" ", pieces.SPACE)
        best = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - table.longest), end):
                part = word[start:end]
                gain = value.get(part, pieces.SPELLED * len(part.encode()) if end - start == 1 else -math.inf)
                best[end] = max(best[end], best[start] + gain)
        assert math.isclose(sum(value[names[i]] if i in names else pieces.SPELLED for i in r["ids"]), best[-1])


def test_pieces_in_small_batches(spark, odd, monkeypatch):
    model = public_tokenizers.path(catalog.PIECE_MODEL)
    monkeypatch.setattr(pieces, "FLUSH", 20)
    found = pieces.encode(odd, model).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in found) == Counter((i, t) for i, t, _, _ in ODD)
    assert all((r["ids"] is None) == (r["decoded"] is None) for r in found)


def test_sizes_that_a_prefix_allows(spark):
    table = pieces.Pieces(public_tokenizers.path(catalog.PIECE_MODEL))
    allowed = {r["prefix"]: r["sizes"] for r in table.sizes(spark).collect()}
    for piece, _, _ in table.rows:
        if len(piece) >= pieces.PREFIX:
            assert len(piece) in allowed[piece[: pieces.PREFIX]]
    held = {piece for piece, _, _ in table.rows}
    for prefix, sizes in allowed.items():
        assert [k for k in sizes if k < pieces.PREFIX] == [k for k in range(2, pieces.PREFIX) if prefix[:k] in held]


def test_caches_are_released():
    workers.worker_cache("tested")["kept"] = 1
    workers.release_caches()
    assert workers.worker_cache("tested") == {}


def vectors(spark, rows):
    return stage(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row long"), "vectors")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((300, 16))
    near = points[:40] + 0.02 * rng.standard_normal((40, 16))
    dense = points[50] + 0.03 * rng.standard_normal((60, 16))
    rows = [(i, x.tolist(), 0, 1) for i, x in enumerate(np.concatenate([points, near, dense, points[60:63]]).astype(np.float32))]
    odd = [(900, None, 0, 1), (901, [0.0] * 16, 0, 1), (902, [math.nan] * 16, 0, 1), (903, [1.0] * 3, 0, 1), (904, [math.inf] + [1.0] * 15, 0, 1)]
    return rows, odd


def test_nearest(spark, cloud):
    rows, odd = cloud
    found = annsearch.nearest(vectors(spark, rows + odd), every=10, k=5).toPandas()
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[::10] @ x.T
    near[np.arange(len(near)), np.arange(0, len(x), 10)] = -2
    true = {(10 * q, int(c)) for q, row in enumerate(near) for c in np.argsort(-row)[:5]}
    got = set(zip(found.query_id, found.vec_id, strict=True))
    assert len(found) == 5 * len(near) and len(got & true) >= 0.9 * len(true)
    assert all(math.isclose(s, near[q // 10, c], abs_tol=1e-12) for q, c, s in zip(found.query_id, found.vec_id, found.score, strict=True))
    few = annsearch.nearest(vectors(spark, rows[:3] + odd), every=1, k=5)
    assert few.count() == 6 and annsearch.nearest(vectors(spark, odd)).count() <= 2
    assert annsearch.nearest(vectors(spark, [])).count() == 0


def test_near_vectors(spark, cloud):
    rows, odd = cloud
    found = {r["vec_id"]: r for r in neargraph.near_vectors(vectors(spark, rows + odd)).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    group = np.arange(len(x))
    for _ in range(len(x)):
        group = np.where(linked, group[None, :], group[:, None]).min(axis=1).clip(max=group)
    assert [found[i]["n_links"] for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert [found[i]["component_id"] for i in range(len(x))] == group.tolist()
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in (900, 901, 902, 904))
    assert neargraph.near_vectors(vectors(spark, [])).count() == 0


def test_language(spark, odd, none, small):
    assert langid.identify(none, None).count() == 0
    net = langid.train(odd, F.col("doc_id"))
    rows = langid.identify(odd, net).collect()
    assert len(rows) == len(ODD) and Counter(r["lang_pred"] == "und" for r in rows)[True] == 4
    assert all(0 <= r["score"] <= 1 for r in rows) and langid.train(none, F.col("doc_id")) is None
    kept = langid.with_known_language(odd, net)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0
    told = catalog.op6_byte_network_language(spark, small).where("held_out").toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").toPandas()
    told = told.merge(docs)
    assert (told.lang_pred == told.lang).mean() >= 0.9


def test_quality(spark, odd, none, small):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    measured = quality.measure(odd)
    model = quality.train(measured, labels, F.col("doc_id"))
    rows = quality.score(measured, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.train(quality.measure(none), labels, F.col("doc_id")) is None
    assert quality.with_good_quality(odd, model).columns == odd.columns
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(4000) < 0.05)).astype(float)
    fitted = quality.AdditiveModel(x[:3000], y[:3000])
    assert ((fitted.score(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.85 and (0, 1) in fitted.pairs


def test_brown(spark, odd, none, small):
    assert brown.score_texts(none, F.lit(True)).count() == 0
    learnt = F.coalesce(F.col("doc_id") != 8, F.lit(True))
    for head in (None, 1):
        rows = brown.score_texts(odd, learnt, exchanged=5, head=head).collect()
        tokens = {(i, t): [*(t or "").encode().lower().split(), None] for i, t, _, _ in ODD}
        seen = Counter(w for (i, _), ws in tokens.items() if i != 8 for w in ws)
        seen[None] = sum(i != 8 for i, _, _, _ in ODD)
        total = sum(len(tokens[(i, t)]) for i, t, _, _ in ODD if i != 8)
        assert {r["train_tokens"] for r in rows} == {total}
        assert sorted(r["n_tokens"] for r in rows) == sorted(len(tokens[(i, t)]) for i, t, _, _ in ODD)
        floor = total + 0.5 * (len(seen) + 1)
        for r in rows:
            text = next(t for i, t, _, _ in ODD if i == r["doc_id"] and len(tokens[(i, t)]) == r["n_tokens"])
            base = sum(math.log10((seen[w] + 0.5) / floor) for w in tokens[(r["doc_id"], text)])
            assert math.isclose(base, r["base_score"], rel_tol=1e-9) and r["score"] < 0
    rows = catalog.op1_brown_classes(spark, small).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_class_chances_sum_to_one():
    rng = np.random.default_rng(5)
    k = brown.K
    types = rng.integers(1, 9, k).astype(float)
    n = types * 3
    single = np.minimum(types, 2.0)
    matrix = rng.integers(0, 20, (k, k + 1)).astype(float)
    chances = 10 ** brown._log_chances(matrix, np.stack([n, types, single]))
    # each class emits its types with their counts plus a half
    whole = (chances[:, :k] * (n + 0.5 * types)).sum(axis=1) + chances[:, k]
    assert np.allclose(whole, 1)


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    for name, function in corpus_pipeline.STAGES:
        after = stage(function(spark, before, small), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
            assert after.join(before, "doc_id", "left_anti").count() == 0
        else:
            assert after.count() == before.count()
        if name == "minhash_near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in after.collect()} == {b for b in brute_groups(rows)[1]}
        before = after


def test_characters_without_pieces_are_spelled(spark):
    """Byte values below 16 and zero, marks, text outside the basic plane; pieces decode in steps of any size."""
    table = pieces.Pieces(public_tokenizers.path(catalog.PIECE_MODEL))
    words = ["\x00", "\x01a\x0b", " ▁x", "￿", "\U0001f9ff\U000e0001", "a\x00\x00b", "ँ࿰"]
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    found = {r["n"]: r for r in pieces.segment(rows, table).collect()}
    text_of = table.decoder()
    assert len(found) == len(words)
    for i, word in enumerate(words):
        assert found[i]["word"] == word
        assert text_of(np.array([table.first_byte, *found[i]["ids"]])) == word
    zero = table.first_byte
    assert found[0]["ids"] == [zero]
    assert found[5]["ids"][1:3] == [zero, zero]


def test_ids_become_text_in_steps(monkeypatch):
    table = pieces.Pieces(public_tokenizers.path(catalog.PIECE_MODEL))
    ids = np.array([table.first_byte + b for b in " é\U0001f9ff".encode()])
    monkeypatch.setattr(pieces, "DECODED", 2)
    assert table.decoder()(ids) == "é\U0001f9ff"
    assert table.decoder()(ids[:0]) == ""


def test_whole_texts_take_the_best_path(spark):
    """Words of marks, runs over 48 characters and random pieces in a row, against Viterbi over the whole text."""
    model = public_tokenizers.path(catalog.PIECE_MODEL)
    table = pieces.Pieces(model)
    value = {p: s for p, _, s in table.rows}
    names = {i: p for p, i, _ in table.rows}
    rng = np.random.default_rng(5)
    crossing = [p for p in value if any(c in ".,;:!?" for c in p) and not all(c in ".,;:!?" for c in p)]
    texts = [
        '"yes."', "../a/b", "a://b ).x", "x  !=y", "-" * 200, "日本語" * 50, "https://a.b/" + "word" * 40, " " * 70 + "x\n\n  \n", "a\r\nb▁c",
        *["".join(rng.choice(list(value), 30)).replace(pieces.SPACE, " ") for _ in range(30)],
        *["".join(rng.choice(crossing, 30)).replace(pieces.SPACE, rng.choice([" ", "e"])) for _ in range(30)],
    ]
    docs = stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "crossing")
    for r in pieces.encode(docs, model).collect():
        text = f" {texts[r['doc_id']]}"
        shape = text.replace(pieces.SPACE, "\uffff").replace(" ", pieces.SPACE)
        best = [0.0] + [-math.inf] * len(shape)
        for end in range(1, len(shape) + 1):
            for start in range(max(0, end - table.longest), end):
                spelled = pieces.SPELLED * len(text[start].encode()) if end - start == 1 else -math.inf
                best[end] = max(best[end], best[start] + value.get(shape[start:end], spelled))
        assert r["decoded"] == text[1:]
        assert math.isclose(sum(value[names[i]] if i in names else pieces.SPELLED for i in r["ids"]), best[-1])


def test_long_and_short_words_are_folded_alike(spark):
    table = pieces.Pieces(public_tokenizers.path(catalog.PIECE_MODEL))
    fold_of = pieces.folder(table.rows, table.prefixes(), table.first_byte)
    words = [" representation", " Thndtiones", "日x", "\x00é\U0001f9ff", ' ("yes."', "aaaaaaaaaa", "-------"]
    for r in pieces.segment(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), table).collect():
        assert np.frombuffer(fold_of(r["word"]), "<u4").tolist() == r["ids"]


def test_bands_follow_the_limit(spark):
    """Pairs just above a limit of 80 or 50 are found; bands are as fine as the limit asks."""
    rng = np.random.default_rng(8)
    for percent, changes in ((80, 4), (50, 13)):
        rows = []
        for i in range(40):
            words = [f"t{i}x{j}" for j in range(204)]
            rows.append((2 * i, " ".join(words)))
            at = 5 + 15 * np.arange(changes) + rng.integers(0, 5, changes)  # five of 200 shingles go with each
            rows.append((2 * i + 1, " ".join(f"c{i}x{j}" if j in at else w for j, w in enumerate(words))))
        groups = brute_groups(rows, percent)[1]
        assert len(set(groups)) == 40
        docs = stage(spark.createDataFrame(rows, "doc_id long, text string"), "limit")
        assert {r["doc_id"] for r in neardup.without_near_duplicates(docs, percent).collect()} == set(groups)
    for percent in (50, 70, 75, 80, 85, 90, 95):
        size = neardup.rows_of_band(percent)
        assert (1 - (percent / 100) ** size) ** (neardup.COORDINATES // size) <= neardup.MISSED


def test_dense_groups_with_weak_cross_links(spark):
    """Links between two groups are weaker than the 40 nearest of every node, and still join the groups."""
    rng = np.random.default_rng(11)
    middle = np.zeros((3, 16))
    middle[0, 0], middle[1, :2], middle[2, 5] = 1, (0.965, math.sqrt(1 - 0.965**2)), 1
    x = np.repeat(middle, 60, axis=0) + 0.002 * rng.standard_normal((180, 16))
    table = vectors(spark, [(i, v, 0, 1) for i, v in enumerate(x.tolist())])
    found = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in neargraph.near_vectors(table).collect()}
    assert found == {i: (0, 119) if i < 120 else (120, 59) for i in range(180)}


def test_audit_sees_small_groups():
    """A hot group does not outweigh small ones that were lost; without links there is no share."""
    hot = [(2, 5000, 5000)] * 64
    assert neargraph._recall(hot + [(1, 2, 2)] * 3 + [(0, 1, 0)], {0: 1, 1: 3, 2: 5000}) == 0.75
    assert neargraph._recall(hot + [(1, 4, 1), (0, 0, 0)], {0: 900, 1: 1, 2: 5000}) == 0.25
    assert neargraph._recall([(0, 0, 0)] * 5, {0: 5}) is None


def test_audit_without_links_is_null(spark):
    far = vectors(spark, [(i, [float(i == j) for j in range(8)], 0, 1) for i in range(8)])
    assert [(r["n_links"], r["audit_recall"]) for r in neargraph.near_vectors(far).collect()] == [(0, None)] * 8


def test_lost_links_are_found_in_blocks(spark, cloud, monkeypatch):
    """A descent that finds nothing does not end the work: the audit tells, and all blocks are compared."""
    nothing = spark.createDataFrame([], neargraph.EDGE), spark.createDataFrame([], "node long")
    monkeypatch.setattr(neargraph, "_graph", lambda *_: nothing)
    monkeypatch.setattr(neargraph, "ATTEMPTS", 1)
    monkeypatch.setattr(neargraph, "BLOCK", 32)
    rows, _ = cloud
    found = {r["vec_id"]: r for r in neargraph.near_vectors(vectors(spark, rows)).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    assert [found[i]["n_links"] for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert {r["audit_recall"] for r in found.values()} == {1.0}


def test_words_are_cut_as_bytes_are_split(monkeypatch):
    from textmap.llm import lookup

    texts = ["", None, " A b\tC\n", "É ÀB x \x1c y\x85z q", "\x0b\x0cAa  aa\r\n", "x" * 40, "\x1f a\x00b　c\xa0d", "  "]
    for size in (1, 16, 1 << 20):
        monkeypatch.setattr(lookup, "BYTES_AT_ONCE", size)
        found = [[] for _ in texts]
        for first, n_texts, words, text in lookup.words_in(pa.array(texts)):
            assert text.max(initial=0) < n_texts
            for word, i in zip(words.to_pylist(), text, strict=True):
                found[first + i].append(word)
        assert found == [(t or "").encode().lower().split() for t in texts]


def test_brown_rounds_ship_a_row_per_word_and_rare_words_may_span_batches():
    """A task ships one row for each word it met, not one for each pair; the uses of a rare word need not come at once."""
    k, classes = brown.K, np.array([0, 1, 2, -1, brown.END])
    rng = np.random.default_rng(3)
    pairs = [pa.record_batch([pa.array(rng.integers(0, 5, 40), t) for t in (pa.int32(), pa.int32(), pa.int64())], ["a", "b", "n"]) for _ in range(3)]
    expected = np.zeros((5, 2 * k))
    for a, b, n in (row for batch in pairs for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
        if classes[b] >= 0:
            expected[a, classes[b]] += n
        if classes[a] >= 0:
            expected[b, k + classes[a]] += n
    sides = list(brown._sides(classes)(brown._packed(iter(pairs))))
    assert sum(b.num_rows for b in sides) == 5
    merged = list(brown._merged(5)(iter(sides + sides)))
    assert np.array_equal(brown._vectors(merged[0].column(1).to_pylist(), merged[0].column(2).to_pylist()), 2 * expected)
    matrix = rng.random((k, k)) * 9
    rows = [(b"a", [5, 70]), (b"a", [70]), (b"b", [9]), (b"b", [40, 41]), (b"b", [3]), (b"c", [1])]

    def placed(sizes):
        parts = iter(rows)
        some = [[next(parts) for _ in range(n)] for n in sizes]
        batches = [pa.record_batch([pa.array([w for w, _ in p], pa.binary()), pa.array([c for _, c in p], pa.list_(pa.int16()))], ["word", "cells"]) for p in some]
        return [r for b in brown._place(matrix)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]

    whole = placed([6])
    assert [(w, n) for w, n, _ in whole] == [(b"a", 3), (b"b", 4), (b"c", 1)]
    assert all(placed(sizes) == whole for sizes in ([1] * 6, [3, 3], [2, 4], [4, 1, 1]))


def test_texts_are_cut_at_once_as_by_the_pattern():
    """Many texts as one array of bytes, beside one another and in slices, against the pattern on each."""
    table = pieces.Pieces(public_tokenizers.path(catalog.PIECE_MODEL))
    split = pieces.splitter(table.cuts)
    rng = np.random.default_rng(9)
    signs = ["a", "s", " ", "  ", "\n", "\r", "\t", ".", "!=", "://", "é", "«", "’", "汉", "😀", pieces.SPACE, "x" * 60, "é" * 47, "é" * 48]
    texts = [None, "", " ", "a ", " a", "a\n b", *["".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(0, 12))) for _ in range(3000)]]
    for column in (pa.array(texts, pa.string()), pa.array(["before", *texts], pa.string()).slice(1)):
        words, long, n_words = table.cutter.words(column)
        found = [w.decode() for w in words.to_pylist()]
        ends = np.append(0, np.cumsum(n_words))
        assert [found[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [split(t) for t in texts]
        assert long.tolist() == [len(w) > pieces.LONG for w in found]
    several = pieces.Cutter(["a\nb"])
    assert several.words(pa.array(["a b\nc.", ""]))[0].to_pylist() == [b" a b\nc."]


def test_chunks_do_not_follow_batches(monkeypatch):
    monkeypatch.setattr(pieces, "FLUSH", 10)
    texts = ["abc", None, "", "x" * 25, "abcdef", "abcdef", "y", "z"]
    whole = pa.record_batch([pa.array(texts)], ["text"])
    for size in (1, 2, 3, 8):
        batches = (whole.slice(i, size) for i in range(0, len(texts), size))
        found = [pieces.texts_in(c).to_pylist() for c in pieces.chunks(batches)]
        assert found == [["abc", None, "", "x" * 25], ["abcdef", "abcdef"], ["y", "z"]]


def test_words_meet_their_edges_in_small_blocks(spark, odd, monkeypatch):
    """Blocks and chunks of a few words give the ids of large ones."""
    model = public_tokenizers.path(catalog.PIECE_MODEL)
    large = Counter((r["doc_id"], r["n_words"], tuple(r["ids"] or [-1])) for r in pieces.encode(odd, model).collect())
    for name, value in (("BLOCK", 7), ("FLUSH", 30), ("COUNTED", 5)):
        monkeypatch.setattr(pieces, name, value)
    small = pieces.encode(odd, model, head=3).collect()
    assert Counter((r["doc_id"], r["n_words"], tuple(r["ids"] or [-1])) for r in small) == large


def test_shuffles_of_stored_steps_are_removed(spark, odd):
    """The shuffle files of a stored step go when it ends, and the setting is put back."""
    import time

    from textmap import session

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = spark.conf.get(name, None), shuffled()
    with session.shuffles_removed(spark):
        stored = stage(odd.groupBy("lang").agg(F.count("*").alias("n")), "counted")
    for _ in range(50):
        if shuffled() <= held:
            break
        time.sleep(0.2)
    assert shuffled() <= held
    assert spark.conf.get(name, None) == before
    assert {r["lang"]: r["n"] for r in stored.collect()} == Counter(lang for _, _, lang, _ in ODD)
