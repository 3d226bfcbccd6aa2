"""Source divergence, token counts and spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textmap.llm import catalog, divergence, spelling, tokencount
from textmap.llm.stretches import stretches
from textmap.session import stage

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n long, term string, word string, cell long, total long"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LOWER = {c: c + 32 for c in range(65, 91)}


def docs_of(spark, rows):
    return stage(spark.createDataFrame([(*r, 5, "x", "y", 7, 9) for r in rows], DOCS), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_stretches():
    body = b"aa bb  " + b"c" * 30 + b" dd " * 9
    for size in (1, 2, 5, 16, 1000):
        parts = list(stretches(body, size=size))
        assert b"".join(parts) == body and [w for p in parts for w in p.split()] == body.split()
    assert list(stretches(b"")) == [b""] and list(stretches(b"x" * 50, size=4)) == [b"x" * 50]


# op11


def divergence_by_hand(rows, min_docs, top):
    uses, held = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        uses[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in uses}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        groups = {s: c for (own, s), c in uses.items() if own == lang}

        def price(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept}

        q, p = price(sum(groups.values(), Counter())), {s: price(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_odd_rows(spark, none):
    rows = [
        (1, "Ab ab É é x1y", "en", "a"), (2, None, None, None), (3, "", "en", ""), (4, "ab cd", "en", "b"),
        (4, "ab cd", "en", "b"), (None, "cd zz", "en", None), (5, "alone", "de", "a"), (6, "42 ,;", "fr", "ü"),
        (7, "zz ab", "en", "z"), (8, "zz ab", "en", "y"), (9, "word " * 3000 + "ab", "en", "b"), (10, "自 自 ab", None, "c"),
    ]
    docs = docs_of(spark, rows)
    for least, top in ((1, 50), (2, 1), (9, 3)):
        assert rows_of(divergence.audit(docs, least, top)) == divergence_by_hand(rows, least, top)
    assert divergence.audit(none).count() == 0


def test_divergence_many_groups(spark, monkeypatch):
    """More sources than a block holds and more terms than a tile is wide; tasks hand on early."""
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = np.random.default_rng(3)
    rows = [
        (i, " ".join(f"t{chr(97 + a % 26)}{chr(97 + a // 26 % 26)}{chr(97 + a // 676)}" for a in rng.zipf(1.3, 40) % 3000), "en", f"s{int(k)}")
        for i, k in enumerate(rng.zipf(1.4, 700) % 150)
    ]
    docs = docs_of(spark, rows)
    assert rows_of(divergence.audit(docs, 1, 7)) == divergence_by_hand(rows, 1, 7)


def test_joint_walk():
    rng = np.random.default_rng(5)
    for n_a, n_b, width, n in ((64, 64, 1024, 900), (3, 40, 1000, 5), (17, 1, 1, 1), (20, 20, 700, 0), (5, 5, 0, 0)):
        trees, tables = [], []
        for rows in (n_a, n_b):
            table = np.zeros((rows, width), np.int64)
            if n:
                table[rng.integers(0, rows, n), rng.integers(0, width, n)] = rng.integers(1, 10**6, n)
            totals = table.sum(axis=1) + 5 * width + 3
            r, c = np.nonzero(table)
            trees.append(divergence.QuadTree(table[r, c] << 16 | r * divergence.COLS + c, totals, width))
            tables.append([[1 + 10**9 * (int(x) + 5) // int(t) for x in row] for row, t in zip(table, totals, strict=True)])
        found = divergence.joint_walk(*trees)[:n_a, :n_b]
        assert found.tolist() == [[sum(abs(x - y) for x, y in zip(a, b, strict=True)) for b in tables[1]] for a in tables[0]]


def test_prices_are_exact():
    counts, totals = np.array([0, 1, 10**15, 3, 10**14]), np.array([7, 6, 4 * 10**15 + 7, 9 * 10**15, 10**14 + 5])
    assert divergence.prices(counts, totals).tolist() == [1 + 10**9 * (int(c) + 5) // int(t) for c, t in zip(counts, totals, strict=True)]


# op12


def library_counts(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD_TEXTS = [
    None, "", " ", "   a", "a\n\n b\t", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "it's WE'LL 'tis ''ve",
    "½ Ⅳ ² 12 １２", "汉字 漢字", "😀😀 x😀", "\U0001e900՘ ₟", " x 　 y z\u0085", "é ﬁ", "x" * 70_000,
    "ab " * 400_000, " " * 5000, "qzxv" * 30, "\x00\x01 \x7f", "naïve café déjà-vu", "1,000.00$ (a+b)=c?!",
]


def test_token_counts(spark, none, monkeypatch):
    rows = [(i // 2, t, "en", "a") for i, t in enumerate(ODD_TEXTS * 2)] + [(None, "null id", None, None)]
    expected = library_counts([r[1] for r in rows])
    found = tokencount.count_tokens(docs_of(spark, rows), BYTES, 2).collect()
    sizes = [len((t or "").encode()) for _, t, _, _ in rows]
    key = lambda r: (r[0] is not None, *map(int, [r[0] or 0, *r[1:]]))
    wanted = [(r[0], s, n, n > 2) for r, s, n in zip(rows, sizes, expected, strict=True)]
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)
    assert tokencount.count_tokens(none, BYTES).count() == 0


def test_token_counts_of_random_texts():
    whole, odd, special = tokencount.proven(BYTES)
    counter = tokencount.Counter(BYTES, whole, odd, special)
    counter.limit = len(whole) + 3  # forget early
    rng = np.random.default_rng(2)
    parts = [*"ab 1é½汉字!.,'", "  ", "\n", "\t ", "'s", "'Re", " ", "　", "😀", "՘", "<|endoftext|>", "<|", "the", " The"]
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(3000)]
    assert [counter.count(t) for t in texts] == library_counts(texts)
    assert all(len(counter.library.encode(w, add_special_tokens=False).ids) == 1 for w in whole[::50])


def test_token_counts_of_documents(spark, small):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    found = {r.doc_id: r.n_tokens for r in catalog.op12_whole_token_counts(spark, small).collect()}
    assert found == dict(zip(texts, library_counts(texts.values()), strict=True))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="no shortcut"):
        tokencount.proven(public_tokenizers.path("word_bpe_49k.json"))


# op13


def near_by_hand(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows, min_length=5, min_uses=3):
    uses = Counter()
    for i, text, _, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            uses[run] += 1
    words = {w: n for w, n in uses.items() if len(w) >= min_length and n >= min_uses}
    near = {w: [x for x in words if near_by_hand(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, words[w], len(near[w]), words[form[w]] if form[w] else 0))
    return sorted(out)


def variant_rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_variants_odd_rows(spark, none):
    rows = [
        (1, "color " * 9 + "Colour " * 4 + "colours " * 3, "en", "a"), (2, None, None, None), (3, "", "en", ""),
        (4, "colqr colqr colqr", "en", "b"), (4, "colqr colqr colqr", "en", "b"), (None, "naïve naïve naïve naive " * 2 + "naive " * 9, None, None),
        (5, "łabcde abcde ÀBCDE abcd" * 3, "de", "a"), (6, "listen silent " * 5, "en", "a"), (7, ("x" * 1500 + " ") * 3 + ("x" * 1499 + "y ") * 8, "en", "a"),
        (8, "aaaaa aaaaaa aaaaaaa " * 3 + "aaaaaa aaaaaaa " * 4 + "aaaaaaa " * 9, "en", "a"), (9, "tiesx tiesy tiesz " * 3 + "tiesx tiesy " * 6, "en", "a"),
    ]
    docs = docs_of(spark, rows)
    assert variant_rows(spelling.variants(docs)) == variants_by_hand(rows)
    assert variant_rows(spelling.variants(docs, 1, 1)) == variants_by_hand(rows, 1, 1)
    assert spelling.variants(none).count() == 0


def test_variants_in_cut_blocks(spark, monkeypatch):
    """Crowded cells are cut and every cut meets every other; tasks hand on early; slices are small."""
    monkeypatch.setattr(spelling, "BLOCK", 7)
    monkeypatch.setattr(spelling, "SLICE", 128)
    monkeypatch.setattr(spelling, "HELD", 60)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aabbgmé"), rng.integers(4, 8))) for _ in range(900)]
    rows = [(i, " ".join(words[k] for k in rng.zipf(1.2, 60) % 900), "en", "a") for i in range(150)]
    assert variant_rows(spelling.variants(docs_of(spark, rows))) == variants_by_hand(rows)


def test_near_pairs_by_brute_force():
    rng = np.random.default_rng(6)
    for length in (1, 2, 5, 9):
        a, b, c = (sorted({"".join(rng.choice(list("abcÿ"), n)) for _ in range(80)}) for n in (length, length, length + 1))
        for left, right in ((a, b), (a, c), (a, a)):
            found = set(zip(*(x.tolist() for x in spelling.near_pairs(left, right)), strict=True))
            assert found == {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if near_by_hand(x, y)}


def test_links_of_a_batch_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    words = sorted(f"abcd{a}{b}" for a in "efgh" for b in "efgh")
    row = {"same": True, "left": words, "n_left": list(range(16)), "right": words, "n_right": list(range(16))}
    batch = pa.RecordBatch.from_pylist([row] * 5)
    whole = [r for part in spelling._links(iter([batch])) for r in part.to_pylist()]
    monkeypatch.setattr(spelling, "LINKS_HELD", 8)
    parts = list(spelling._links(iter([batch])))
    assert len(parts) > 4 and max(p.num_rows for p in parts) < len(whole)
    assert [r for part in parts for r in part.to_pylist()] == whole
