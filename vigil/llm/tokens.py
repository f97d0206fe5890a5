"""Token counts with overlap resynchronisation (operator 7).

A document longer than one chunk is encoded in overlapping chunks with
offsets; neighbouring encodings are spliced at a proven boundary, a place in
the overlap where both have a token start right after ASCII white space.  The
tokenizer drops white space, splits words before merging and normalises
without looking across it, so tokens on either side of such a place do not
depend on the other side.  Where an overlap has no common boundary (one
unbroken word) it is widened until it has one or the chunk covers the rest.

Within a chunk every distinct word piece is encoded by the library once a
task; words with characters outside the plain Latin letters and documents with
special-token strings go to the library as they stand.

Defined results: null text counts as empty (0 tokens); repeated rows return
one row each; an empty table an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import map_texts

CHUNK = 32_768        # characters of a chunk
OVERLAP = 512         # characters two chunks share at first
CACHE = 1_000_000     # distinct pieces kept by a worker before it starts anew

# The pre-tokenizer's pieces for plain Latin text, lower case.
_L = "a-zªµºß-öø-ÿ"
_N = "0-9²³¹¼-¾"
RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}\\s]+")
# words made of these only are stable under NFC and lower-cased alone
UNSAFE = re.compile("[^\t-\r\x20-\x7e¡-ÿ]")
WORD = re.compile("[^\t-\r\x20]+")


_COUNTERS: dict = {}


def counter_for(path: str) -> "Counter":
    """One counter a worker process: later tasks of the worker reuse its pieces."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


class Counter:
    """Counts tokens of text pieces through the library, each piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        if RULE not in (r["pattern"].get("Regex") for r in json.loads(self.tok.to_str())["pre_tokenizer"].get(
                "pretokenizers", []) if r["type"] == "Split"):
            raise ValueError(f"{path}: not a tokenizer that drops white space and splits by {RULE}")
        self.special = [str(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}
        self.pieces: dict[str, int] = {}

    def _learn(self, new: list[str]) -> None:
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        model = self.tok.model
        for p in new:
            if p[-1] == " ":                                    # a raw word: the whole pipeline
                self.pieces[p] = len(self.tok.encode(p, add_special_tokens=False).ids)
            else:                                               # one normalised piece: its merges only
                self.pieces[p] = len(model.tokenize(p if p.isascii() else p.translate(self.bytes)))

    def split(self, text: str) -> list[str]:
        """The independent pieces of a text, in order: normalised pieces, and raw
        words marked by a space behind them."""
        if any(s in text for s in self.special):
            return [w + " " for w in WORD.findall(text)]
        if not UNSAFE.search(text):
            return PIECE.findall(text.lower())
        out = []
        for w in WORD.findall(text):
            if UNSAFE.search(w):
                out.append(w + " ")
            else:
                out.extend(PIECE.findall(w.lower()))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of every text."""
        cut = [self.split(t) for t in texts]
        seen = self.pieces
        missing = {p for pieces in cut for p in pieces if p not in seen}
        if missing:
            self._learn(list(missing))
            seen = self.pieces
            lost = {p for pieces in cut for p in pieces if p not in seen}   # the cache was emptied
            if lost:
                self._learn(list(lost))
        return [sum(map(seen.__getitem__, pieces)) for pieces in cut]

    def starts(self, text: str, low: int, high: int) -> np.ndarray:
        """Offsets in ``text`` at which a token of text[low:high] starts."""
        found = self.tok.encode(text[low:high], add_special_tokens=False).offsets
        return np.unique(np.fromiter((s for s, _ in found), np.int64, len(found))) + low


def splice_points(text: str, counter: Counter, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Cut places of a long text, each proven by two overlapping encodings.

    Chunk A ends at ``end``, chunk B starts ``overlap`` characters before.
    Both are encoded around their overlap, A with its own left and B with its
    own right context; a place counts when both start a token there and the
    character before it is ASCII white space.  The middle one is taken; the
    overlap is doubled while there is none, and where even the whole chunk
    has none (one unbroken word) the chunk grows.
    """
    a, n, cuts = 0, len(text), []
    while a + chunk < n:
        end, width, cut = a + chunk, overlap, None
        while cut is None and end < n:
            b = max(a, end - width)
            in_a = counter.starts(text, max(a, b - overlap), end)
            in_b = counter.starts(text, b, min(n, end + overlap))
            common = [p for p in np.intersect1d(in_a, in_b) if b < p < end and text[p - 1] in " \t\n\x0b\x0c\r"]
            if common:
                cut = int(common[len(common) // 2])
            elif b > a:
                width *= 2
            else:
                end, width = min(n, end + chunk), overlap
        if cut is None:
            break
        cuts.append(cut)
        a = cut
    return cuts


def count_texts(texts: list, counter: Counter, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Token counts of whole texts; long ones chunk by chunk, spliced."""
    whole: list[str] = []
    owner: list[int] = []
    total = [0] * len(texts)

    def flush():
        for i, c in zip(owner, counter.counts(whole), strict=True):
            total[i] += c
        whole.clear()
        owner.clear()

    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        bounds = [0, *splice_points(t, counter, chunk, overlap), len(t)] if len(t) > chunk else [0, len(t)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            whole.append(t[a:b])
            owner.append(i)
            size += b - a
            if size >= 4_000_000:
                flush()
                size = 0
    flush()
    return total


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
                 limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.  ``tokenizer`` is the
    path of a tokenizers JSON file present on every worker."""
    def run(texts):
        return [count_texts(texts, counter_for(tokenizer), chunk, overlap)]

    n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes")
    out = map_texts(docs, [id_col, n_bytes], text, run, {"n_tokens": "long"})
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
