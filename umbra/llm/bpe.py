"""Byte-pair encoding and decoding of whole texts, long ones by tree concatenation.

A text is normalised and cut at special tokens. A short one is encoded in one go, word by word. A long one is halved until
its blocks are short enough, wherever the cuts fall, and the blocks are encoded apart, in parallel. Then neighbours are
joined, pairs first, pairs of pairs next: a window around the join is read again, and grows until its words end where the
right side's words end; from there on both sides agree, as reading goes on alike from any word end. A word that goes on over
a cut has the tokens of its two parts joined in the same way: a window of tokens is encoded again and grows until it fits both
its neighbours. Two tokens fit if their joint text encodes to just them, and a sequence of which all neighbours fit is the encoding.

The last joins of a text happen in one task, as its tokens become one row.

Words: as the tokenizer file's pre-tokenizer cuts them. Texts of letters up to U+024F go through an equal pattern here, all
others through the tokenizers library's own normaliser and pre-tokenizer. Null text: as empty, no tokens. Equal rows: equal results.
Columns of other names pass through; `ids` and `decoded` are replaced.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.llm.common import small_batches, written

#: Code points of text that one task encodes in one go.
BLOCK = 1 << 16
#: Code points of a first window, and what may still change before a cut: a contraction has three.
WINDOW, UNSURE = 64, 3
#: Words, and pairs of tokens, whose encoding a worker keeps.
CACHE = 1 << 17
#: Bytes of a word up to which all its pairs are looked through for each merge.
SHORT = 64
#: Room for a token's number beside another one or a rank, and a rank after all others.
BITS = 24
MASK, NEVER = (1 << BITS) - 1, 1 << 62
#: Up to here letters and numbers keep their classes in all Unicode versions in use, and texts are in normal form as they are.
FAR = 0x250
#: White space up to U+024F.
SPACE = r"\t-\r\x20\x85\xa0"


class Encoder:
    """The tokenizer file's merges by token numbers."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        self.text = text
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        # A pair, and a rank with the new token, are one number each: quick to make, to look up and to compare.
        self.merge = {vocab[a] << BITS | vocab[b]: rank << BITS | vocab[a + b] for rank, (a, b) in enumerate(spec["model"]["merges"])}
        chars = _byte_chars()
        self.byte = [vocab[c] for c in chars]
        self.last = [vocab[c + self.suffix] for c in chars]
        self.bytes_of = {c: i for i, c in enumerate(chars)}
        pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.pattern = pattern
        near = {kind: "".join(re.escape(chr(c)) for c in range(FAR) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
        self.words = re.compile(pattern.replace(r"\s", SPACE).replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"[^" + SPACE + r"\p{L}\p{N}]", f"[^{SPACE}{near['L']}{near['N']}]").replace(r"\p{L}", f"[{near['L']}]").replace(r"\p{N}", f"[{near['N']}]"))
        self.far = re.compile(f"[^\x00-{chr(FAR - 1)}]")
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.known: dict[str, int] = {}
        self.flat, self.first = array("i"), array("q", [0])
        self.older = self.known, self.flat, self.first
        self.fit: dict[tuple[int, int, bool], bool] = {}

    @functools.cached_property
    def library(self) -> tuple:
        """The library's normaliser and pre-tokenizer, for texts with far characters; made only where one comes."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        return Tokenizer.from_str(self.text).normalizer, pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)

    def normal(self, text: str) -> str:
        return self.library[0].normalize_str(text) if self.far.search(text) else text.lower()

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where the words of normalised text lie."""
        if self.far.search(text):
            return [at for _, at in self.library[1].pre_tokenize_str(text)]
        return [m.span() for m in self.words.finditer(text)]

    def word_list(self, text: str) -> list[str]:
        if self.far.search(text):
            return [text[a:b] for _, (a, b) in self.library[1].pre_tokenize_str(text)]
        return self.words.findall(text)

    def merged(self, data: bytes, closed: bool) -> list[int]:
        """The encoding of a word's bytes; an open one goes on, its last byte isn't a word's last. Of the pairs that can merge, the
        leftmost of least rank does, again and again: looked for among all pairs of a short word, kept in a heap for a long one."""
        ids = [self.byte[c] for c in data]
        if closed and data:
            ids[-1] = self.last[data[-1]]
        n, get, none = len(ids), self.merge.get, NEVER
        if n <= SHORT:
            pairs = [get(a << BITS | b, none) for a, b in itertools.pairwise(ids)]
            while pairs and (least := min(pairs)) is not none:
                i = pairs.index(least)
                new = least & MASK
                ids[i : i + 2] = (new,)
                del pairs[i]
                if i:
                    pairs[i - 1] = get(ids[i - 1] << BITS | new, none)
                if i < len(pairs):
                    pairs[i] = get(new << BITS | ids[i + 1], none)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << BITS | ids[i + 1], none)) is not none]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << BITS | ids[j], none) != least:
                continue
            new = ids[i] = least & MASK
            ids[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := get(ids[x] << BITS | ids[y], none)) is not none:
                    heapq.heappush(heap, (m, x))
        return [x for x in ids if x >= 0]

    def learn(self, word: str) -> int:
        """The place of a word's tokens among those kept."""
        place = self.older[0].get(word)
        if place is None:
            self.flat.extend(self.merged(word.encode("utf-8", "surrogatepass"), True))
        else:
            _, flat, first = self.older
            self.flat.extend(flat[first[place] : first[place + 1]])
        self.first.append(len(self.flat))
        place = self.known[word] = len(self.first) - 2
        return place

    def forget(self) -> None:
        """Once CACHE words are kept, they become the older ones, which go when the next ones do; words met again stay."""
        if len(self.known) >= CACHE:
            self.older = self.known, self.flat, self.first
            self.known, self.flat, self.first = {}, array("i"), array("q", [0])

    def word(self, word: str) -> list[int]:
        self.forget()
        place = self.known.get(word)
        if place is None:
            place = self.learn(word)
        return self.flat[self.first[place] : self.first[place + 1]].tolist()

    def tokens(self, words: list[str]) -> np.ndarray:
        """The tokens of many words, in order."""
        self.forget()
        try:
            places = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            for w in words:
                if w not in self.known:
                    self.learn(w)
            places = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        first = np.frombuffer(self.first, np.int64)
        starts, counts = first[places], first[places + 1] - first[places]
        upto = np.cumsum(counts)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + counts, counts)
        return np.frombuffer(self.flat, np.int32)[at] if len(at) else np.zeros(0, np.int32)

    def data(self, ids: list[int]) -> tuple[bytes, bool]:
        """The bytes of tokens of one word, and whether the last one ends it."""
        text = "".join(self.token[i] for i in ids)
        closed = bool(self.suffix) and text.endswith(self.suffix)
        return bytes(self.bytes_of[c] for c in (text[: -len(self.suffix)] if closed else text)), closed

    def fits(self, a: int, b: int) -> bool:
        if (known := self.fit.get((a, b))) is None:
            if len(self.fit) >= CACHE:
                self.fit.clear()
            known = self.fit[a, b] = self.merged(*self.data([a, b])) == [a, b]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of a word from those of its two parts."""
        if not left or not right:
            return left + right
        size = 1
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            middle = self.merged(*self.data(left[i:] + right[:j]))
            if (i == 0 or self.fits(left[i - 1], middle[0])) and (j == len(right) or self.fits(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            size *= 2

    def closed(self, ids: list[int]) -> list[int]:
        """An open word's tokens once it turns out that the word ends there."""
        size = 1
        while ids:
            i = max(0, len(ids) - size)
            tail = self.merged(self.data(ids[i:])[0], True)
            if i == 0 or self.fits(ids[i - 1], tail[0]):
                return ids[:i] + tail
            size *= 2
        return ids

    def units(self, text: str) -> list[tuple[str, int]]:
        """Normalised text up to each special token, with that token's number or -1."""
        out, at = [], 0
        for m in self.marks.finditer(text):
            out.append((self.normal(text[at : m.start()]), self.special[m[0]]))
            at = m.end()
        return [*out, (self.normal(text[at:]), -1)]

    def ids(self, text: str) -> np.ndarray:
        out = []
        for unit, mark in self.units(text):
            out.append(self.tokens(self.word_list(unit)))
            if mark >= 0:
                out.append(np.array([mark], np.int32))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def block(self, text: str, last: bool) -> Block:
        """Words of a block. Unless it is the last, a word that reaches its end is left open."""
        spans = self.spans(text)
        ids = [self.word(text[a:b]) for a, b in spans]
        opened = bool(spans) and not last and spans[-1][1] == len(text)
        if opened:
            a, b = spans[-1]
            ids[-1] = self.merged(text[a:b].encode("utf-8", "surrogatepass"), False)
        return Block(text, spans, ids, opened, last)

    def concatenated(self, left: Block, right: Block) -> Block:
        """Two neighbouring blocks as one."""
        cut, text = len(left.text), left.text + right.text
        keep = len(left.spans)
        while keep and left.spans[keep - 1][1] > cut - UNSURE:
            keep -= 1
        start = left.spans[keep - 1][1] if keep else 0
        ends = {b: i for i, (_, b) in enumerate(right.spans)}
        size = WINDOW
        while True:
            stop = min(len(text), cut + size)
            sure = stop if stop == len(text) and right.last else stop - UNSURE
            window = [(a + start, b + start) for a, b in self.spans(text[start:stop])]
            agreed = next((k for k, (_, b) in enumerate(window) if b > cut and b <= sure and b - cut in ends and not (right.opened and ends[b - cut] == len(right.spans) - 1)), None)
            if agreed is not None or stop == len(text):
                break
            size *= 2
        if agreed is None:
            # No word of the right side ends inside it: the window went over all of it.
            spans, rest, opened = window, [], bool(window) and not right.last and window[-1][1] == len(text)
        else:
            follow = ends[window[agreed][1] - cut] + 1
            spans, rest, opened = window[: agreed + 1], list(range(follow, len(right.spans))), right.opened
        new = [self._window_word(left, right, text, cut, a, b, opened and not rest and b == len(text)) for a, b in spans]
        return Block(text, left.spans[:keep] + spans + [(right.spans[k][0] + cut, right.spans[k][1] + cut) for k in rest], left.ids[:keep] + new + [right.ids[k] for k in rest], opened, right.last)

    def _window_word(self, left: Block, right: Block, text: str, cut: int, a: int, b: int, opened: bool) -> list[int]:
        """Tokens of the word from a to b: those of its parts joined, if it is the left side's open word and the right side's first."""
        if b - a > WINDOW and left.opened and left.spans[-1][0] == a:
            if b == cut:
                return self.closed(left.ids[-1])
            if right.spans and right.spans[0] == (0, b - cut) and opened == (right.opened and len(right.spans) == 1):
                return self.joined(left.ids[-1], right.ids[0])
        data = text[a:b]
        return self.merged(data.encode("utf-8", "surrogatepass"), False) if opened else self.word(data)


class Block:
    def __init__(self, text: str, spans: list[tuple[int, int]], ids: list[list[int]], opened: bool, last: bool) -> None:
        self.text, self.spans, self.ids, self.opened, self.last = text, spans, ids, opened, last


def tree(encoder: Encoder, blocks: list[Block]) -> Block:
    while len(blocks) > 1:
        blocks = [encoder.concatenated(*blocks[i : i + 2]) if i + 1 < len(blocks) else blocks[i] for i in range(0, len(blocks), 2)]
    return blocks[0]


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def _encoder(text: str) -> Encoder:
    return Encoder(text)


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file, a few MB whatever the corpus, so executors need no copy of it."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encode(docs: DataFrame, path: str, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Adds `ids`, array of token numbers."""
    held = vocabulary(docs.sparkSession, path)
    keep = docs.drop("ids")
    size = F.length(F.coalesce(text_col, F.lit("")))
    schema = T.StructType([*keep.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for b in batches:
            lists = [encoder.ids(t.as_py() or "") for t in b.column(text_col)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, np.concatenate(lists))], [*b.schema.names, "ids"])

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(held.value)
        for b in batches:
            for row, text in zip(b["__row"], b["__text"], strict=True):
                rows, at = [], 0
                for unit, mark in encoder.units(text):
                    parts = _halved(unit, block)
                    for k, part in enumerate(parts):
                        rows.append((row, at, part, k == len(parts) - 1, mark if k == len(parts) - 1 else -1))
                        at += 1
                yield pd.DataFrame(rows, columns=["__row", "at", "part", "last", "mark"])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(held.value)
        for b in batches:
            done = [encoder.block(p, bool(last)) for p, last in zip(b["part"], b["last"], strict=True)]
            yield b.assign(
                starts=[[a for a, _ in x.spans] for x in done], stops=[[e for _, e in x.spans] for x in done], counts=[[len(i) for i in x.ids] for x in done], flat=[[i for w in x.ids for i in w] for x in done], opened=[x.opened for x in done]
            )

    def join(_: tuple, b: pd.DataFrame) -> pd.DataFrame:
        encoder = _encoder(held.value)
        out: list[int] = []
        blocks: list[Block] = []
        for r in b.sort_values("at").itertuples():
            flat, cuts = [int(i) for i in r.flat], np.concatenate(([0], np.cumsum(r.counts))).astype(int)
            blocks.append(Block(r.part, list(zip(map(int, r.starts), map(int, r.stops), strict=True)), [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], bool(r.opened), bool(r.last)))
            if r.last:
                out += [i for w in tree(encoder, blocks).ids for i in w]
                blocks = []
                if r.mark >= 0:
                    out.append(int(r.mark))
        return pd.DataFrame({"__row": [b["__row"].iloc[0]], "ids": [out]})

    near = small_batches(keep.where(size <= block)).mapInArrow(short, schema)
    # Written, so that a row has one number in all that follows, whatever order its input comes in.
    far = written(keep.where(size > block).withColumn("__row", F.monotonically_increasing_id()), "long")
    dealt = far.select("__row", F.col(text_col).alias("__text")).mapInPandas(halves, "__row bigint, at int, part string, last boolean, mark int")
    encoded = dealt.repartition("__row", "at").mapInPandas(parts, "__row bigint, at int, part string, last boolean, mark int, starts array<int>, stops array<int>, counts array<int>, flat array<int>, opened boolean")
    whole = encoded.groupBy("__row").applyInPandas(join, "__row bigint, ids array<int>")
    return near.unionByName(far.join(whole, "__row").select(*[F.col(f"`{c}`") for c in keep.columns], "ids"))


def _halved(text: str, block: int) -> list[str]:
    if len(text) <= block:
        return [text]
    middle = len(text) // 2
    return _halved(text[:middle], block) + _halved(text[middle:], block)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded`: the tokens of `ids`, special ones too, joined by a space, as the tokenizer file has no decoder."""
    held = vocabulary(encoded.sparkSession, path)
    keep = encoded.drop("decoded")
    schema = T.StructType([*keep.schema.fields, T.StructField("decoded", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _encoder(held.value).token
        table = pa.array([token.get(i) for i in range(max(token) + 1)], pa.string())
        for b in batches:
            lists = b.column("ids")
            # An unknown number gives nothing, as in the library.
            shown = pa.ListArray.from_arrays(lists.offsets, table.take(lists.values), mask=lists.is_null()) if not lists.offset else pa.array([None if x is None else [token[i] for i in x if i in token] for x in lists.to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, pc.binary_join(shown, " ")], [*b.schema.names, "decoded"])

    return small_batches(keep).mapInArrow(each, schema)


def query(docs: DataFrame, path: str) -> DataFrame:
    both = decode(encode(docs.select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
