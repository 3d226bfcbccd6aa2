"""Token counts by a shortcut: strings proven to be one token alone are only looked up, the rest is merged.

Byte pair merging never crosses a pre-token. The driver proves once, with the library itself, which strings of the
vocabulary come out as one token, and for which code points our pattern cuts texts as the library does. A task
then cuts each text, adds one for each proven pre-token and merges only the others, each distinct one once while it is
remembered. Texts with another code point are cut by the library; their pre-tokens are counted in the same way.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.workers import worker_cache

PLANE = 0x10000  # code points compared with the library; those beyond are left to it
REMEMBERED = 1_000_000  # merged pre-tokens a worker remembers before it forgets them all
LONG_TOKEN = 64  # longer pre-tokens are not remembered
LONG_TEXT = 1 << 20  # characters; the pre-tokens of longer texts are not listed at once

# Fixed: the cut of byte-level tokenizers of this kind, as their library applies it.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _joined(library, lead: str, points: list[int]) -> set[int]:
    """The code points that the library keeps in one pre-token with ``lead`` before them."""
    found = set()
    for at in range(0, len(points), 1 << 14):
        some = points[at : at + (1 << 14)]
        text = "".join(f"{lead}{chr(p)}\n" for p in some)
        starts = {place[0] for _, place in library.pre_tokenizer.pre_tokenize_str(text)}
        found.update(p for i, p in enumerate(some) if 3 * i + 1 not in starts)
    return found


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


@functools.cache
def proven(tokenizer: str) -> tuple[list[str], list[tuple[int, int]], list[str]]:
    """What the library itself shows, once per driver: whole tokens, code points it must cut, special strings.

    The whole tokens are the strings of the vocabulary that it gives as their own one token. Raises if the
    tokenizer is not of the kind this shortcut holds for.
    """
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    with open(tokenizer, encoding="utf-8") as source:
        plan = json.load(source)
    before = plan["pre_tokenizer"] or {}
    kind = (plan["model"]["type"], before.get("type"), before.get("use_regex"), before.get("add_prefix_space"), plan["normalizer"])
    if kind != ("BPE", "ByteLevel", True, False, None):
        raise ValueError(f"no shortcut is known for a tokenizer of kind {kind}")
    added = plan["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("special strings that take in their surroundings are not covered")
    special = sorted((t["content"] for t in added), key=len, reverse=True)
    texts, ids = [], []
    for token, number in plan["model"]["vocab"].items():
        try:
            text = library.decoder.decode([token])
        except Exception:  # not text by itself
            continue
        if "�" not in text and not any(s in text for s in special):
            texts.append(text)
            ids.append(number)
    encoded = library.encode_batch_fast(texts, add_special_tokens=False)
    whole = [t for t, e, number in zip(texts, encoded, ids, strict=True) if e.ids == [number]]

    points = [p for p in range(PLANE) if not 0xD800 <= p < 0xE000]
    odd = set()
    for lead, own in (("a", r"\p{L}"), ("1", r"\p{N}"), ("!", r"[^\s\p{L}\p{N}]")):
        test = regex.compile(own)
        odd |= _joined(library, lead, points) ^ {p for p in points if test.match(chr(p))}
    return whole, [*_ranges(sorted(odd)), (PLANE, 0x10FFFF)], special


def code_points(ranges: list[tuple[int, int]]) -> str:
    """A pattern of the code points in these ranges."""
    import regex

    return "[" + "".join(f"{regex.escape(chr(a))}-{regex.escape(chr(b))}" for a, b in ranges) + "]"


def _byte_table() -> dict[int, str]:
    """A byte as the library writes it: printable ones stand for themselves, the others for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(free)) for b in range(256)}


_BYTES = _byte_table()
_BLANK = _BYTES[32]


def byte_text(piece: str) -> str:
    """A pre-token in the characters that the library merges."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", _BLANK)
    return piece.encode().decode("latin-1").translate(_BYTES)


class Counter:
    """Counts the tokens of texts; what it remembers is bounded."""

    def __init__(self, tokenizer: str, whole: list[str], odd: list[tuple[int, int]], special: list[str]):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = Tokenizer.from_file(tokenizer)
        self.library, self.merge = library, library.model.tokenize
        self.cut = regex.compile(CUT)
        self.odd = regex.compile(code_points(odd))
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        counter = self

        class Known(dict):
            def __missing__(self, piece: str) -> int:
                n = counter.merged(piece)
                if len(piece) <= LONG_TOKEN:
                    self[piece] = n
                return n

        self.known = Known.fromkeys(whole, 1)
        self.whole = whole
        self.limit = len(whole) + REMEMBERED

    def merged(self, piece: str) -> int:
        return len(self.merge(byte_text(piece)))

    def count(self, text: str) -> int:
        """The number of tokens of ``text``."""
        if len(self.known) > self.limit:
            self.known.clear()
            self.known.update(dict.fromkeys(self.whole, 1))
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        get = self.known.__getitem__
        if self.odd.search(text):
            return sum(get(text[a:b]) for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text))
        if len(text) > LONG_TEXT:
            return sum(get(m.group()) for m in self.cut.finditer(text))
        return sum(map(get, self.cut.findall(text)))


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``, in one narrow pass.

    Tokens are those of the library without tokens added at the ends; special strings inside a text count as
    their one token, as by its default. ``over_limit``: more than ``limit`` tokens. Null texts are empty. Ids may be
    null and rows may repeat: each row is counted by itself. Other columns play no part.
    """
    plan = proven(tokenizer)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("token-counters")
        counter = cache.get(tokenizer) or cache.setdefault(tokenizer, Counter(tokenizer, *plan))
        for batch in batches:
            numbers = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(numbers, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sized = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    numbered = sized.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return numbered.withColumn("over_limit", F.col("n_tokens") > limit)
