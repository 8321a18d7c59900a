"""BPE encoding and decoding as streaming transducers.

`Vocabulary` reads a public tokenizer file: merges by rank over the letters of bytes, with a mark on a
word's last letter if the file has one. `Transducer` takes a document in slices of fixed size, cut
anywhere, and gives the ids that are stable: normalised text, word boundaries and merges pass through one
state, which holds the unfinished word only. A boundary between words is crossed by no merge, so what lies before it is
stable. Within a word a token is stable once the symbols known after its start reach its bound; it is
emitted, leaves, and the rest goes on as a word of its own. So the state is bounded by the vocabulary, not by
the text or its words.

The bounds are computed from the merge list. A token can still change only if its right end r (itself, or
a part that was its right one until a merge of rank k) is taken from it by a merge (r, x) of a rank below k, and whether that
happens depends on the text up to

    reach(r, x) = |r| + max(|x|, place + reach of the merges (e, y) that can take a right end e of x in time)

which is finite as ranks fall along such a chain. A token's bound is the greatest reach from its right ends,
counted from its start; the vocabulary's lookahead is the greatest bound.

A worker remembers the ids of a bounded number of short closed words, which went through the same transducer.

`Decoder` turns a stream of ids back into text: a byte-level vocabulary's bytes run through a UTF-8 state machine
whose state is the unfinished character; without a decoder in the file token texts are joined by a space.

Defined results: null is encoded as the empty text, which has no tokens; repeated rows give
equal rows; an empty table gives an empty result; texts of any length pass in slices (a run of combining marks, which
normalisation orders as a whole, stays in one); columns of the names of the new ones give way to them.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from plumbline.llm.common import table, with_results

#: Words whose ids a worker remembers (it forgets all and goes on at that number), their greatest length, code points a slice, symbols between two emissions.
MEMORY, SHORT, SLICE, STEP = 500_000, 48, 1 << 14, 32
#: The white space of Unicode's property, which is a little less than Python's.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


@cache
def byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 as it is, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class _Rules:
    """The file's rule for words: runs of letters, contractions, single numbers, runs of anything else but space."""

    words: re.Pattern
    letters: re.Pattern
    others: re.Pattern
    number: re.Pattern


def _rules(letter: str = r"[^\W\d_]", number: str = r"\d") -> _Rules:
    other = rf"(?:[^\w{SPACE}]|_)"
    return _Rules(re.compile(rf"{letter}+|'s|'t|'re|'ve|'m|'ll|'d|{number}|{other}+"), re.compile(f"{letter}*"), re.compile(f"{other}*"), re.compile(number))


_PLAIN = _rules()


@cache
def _numbers() -> tuple[frozenset[str], _Rules]:
    """The numbers that Python counts as no digits, such as fractions; and the rules for a text with some."""
    numbers = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()]
    group = "".join(map(re.escape, numbers))
    return frozenset(numbers), _rules(rf"(?:(?![{group}])[^\W\d_])", rf"(?:\d|[{group}])")


#: The numbers of that kind in Latin-1.
_LATIN_NUMBERS = re.compile("[²³¹¼½¾]")


def _has_numbers(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _numbers()[0].isdisjoint(set(text))
    return _LATIN_NUMBERS.search(text) is not None


@cache
def _joins_left() -> frozenset[str]:
    """Characters that normalisation may move or join to what stands before them: marks, and second parts of compositions."""
    jamo = [chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))]
    seconds = [chr(int(d.split()[1], 16)) for c in range(sys.maxunicode + 1) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d]
    return frozenset([*jamo, *seconds, *(chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c)))])


def _slices(text: str, start: int, end: int) -> Iterator[str]:
    """The text between two places in parts of SLICE code points, or a few more where a part would end within a composition."""
    while start < end:
        cut = min(start + SLICE, end)
        while cut < end and text[cut] >= "\u0300" and text[cut] in _joins_left():
            cut += 1
        yield text[start:cut]
        start = cut


class Vocabulary:
    """A tokenizer file: its tokens, merges, special tokens and sufficient lookahead."""

    def __init__(self, text: str):
        file = json.loads(text)
        model = file["model"]
        if model["type"] != "BPE" or model.get("byte_fallback"):
            raise ValueError("a byte-level BPE is needed")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.joined = file["decoder"] is None
        self.texts = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.names = {i: str(i) for i in self.texts}
        self.bound = self._bounds()
        self.lookahead = max(self.bound.values(), default=1)

    def size(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def _bounds(self) -> dict[str, int]:
        """For each token, the symbols from its start on that decide whether it stays (see above)."""
        ends: dict[str, dict[str, tuple[int, int]]] = {}  # a token's right ends: place, and the rank at which they were merged into it
        reach: dict[str, tuple[list[int], list[int]]] = {}  # by left part: ranks of its merges, and the greatest reach so far

        def taken(left: str, rank: int) -> int:
            known = reach.get(left)
            k = bisect_left(known[0], rank) if known else 0
            return known[1][k - 1] if k else 0

        def extent(token: str, rank: int) -> int:
            inner = (place + far for end, (place, merged) in ends.get(token, {}).items() if (far := taken(end, min(merged, rank))))
            return max(self.size(token), taken(token, rank), max(inner, default=0))

        for (a, b), rank in self.ranks.items():
            far, (ranks, most) = self.size(a) + extent(b, rank), reach.setdefault(a, ([], []))
            ranks.append(rank)
            most.append(max(far, most[-1] if most else 0))
            own = ends.setdefault(a + b, {})
            for end, (place, merged) in [(b, (0, rank)), *ends.get(b, {}).items()]:
                own[end] = (self.size(a) + place, max(merged, own[end][1] if end in own else 0))
        return {t: extent(t, len(self.ranks)) for t in self.ids}

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges of least rank first, leftmost first."""
        if len(symbols) > 64:
            return self._merged_long(symbols)
        rank, none = self.ranks.get, 1 << 60
        symbols = list(symbols)
        pairs = [rank(p, none) for p in zip(symbols, symbols[1:])]  # noqa: B905
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank((symbols[i], symbols[i + 1]), none)
            if i:
                pairs[i - 1] = rank((symbols[i - 1], symbols[i]), none)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs and links between neighbours."""
        held: list[str | None] = list(symbols)
        after, before = list(range(1, len(held) + 1)), list(range(-1, len(held) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := self.ranks.get((a, b))) is not None]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= len(held) or held[i] != a or held[j] != b:
                continue
            held[i], held[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(held):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < len(held) and (r := self.ranks.get((held[x], held[y]))) is not None:
                    heapq.heappush(heap, (r, x, held[x], held[y]))
        return [s for s in held if s is not None]


class Transducer:
    """Text in, slice by slice; ids out, as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary, memory: dict[str, list[int]]):
        self.vocabulary, self.memory = vocabulary, memory
        #: the symbols of the word that is open and of which kind it is; characters that may yet become a contraction
        self.held: list[str] = []
        self.kind = ""
        self.tail = ""
        #: the most symbols that were held, for tests
        self.most = 0

    def _push(self, part: str) -> Iterator[int]:
        """More of the open word: what of it is stable, looked for at each step. Its last symbol may be its end, so it isn't known yet."""
        v, letters, data = self.vocabulary, byte_letters(), part.encode("utf-8", "surrogatepass")
        for start in range(0, len(data), STEP):
            self.held += [letters[b] for b in data[start : start + STEP]]
            known, at = len(self.held) - 1, 0
            if known < STEP:
                continue
            self.most = max(self.most, known + 1)
            for token in v.merged(self.held[:known]):
                if at + v.bound[token] > known:
                    break
                at += len(token)
                yield v.ids[token]
            del self.held[:at]

    def _close(self) -> Iterator[int]:
        """The open word ends."""
        if self.held:
            self.held[-1] += self.vocabulary.suffix
            yield from map(self.vocabulary.ids.__getitem__, self.vocabulary.merged(self.held))
            self.held, self.kind = [], ""

    def word(self, word: str) -> list[int]:
        """The ids of a closed word. One of a step or less is closed before anything of it is looked for."""
        v, data = self.vocabulary, word.encode("utf-8", "surrogatepass")
        if len(data) > STEP:
            return [*self._push(word), *self._close()]
        symbols = list(map(byte_letters().__getitem__, data))
        symbols[-1] += v.suffix
        return list(map(v.ids.__getitem__, v.merged(symbols)))

    def feed(self, part: str, final: bool = False) -> list[int]:
        """The ids that this slice makes stable; final: the text ends here."""
        part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # letter by letter, so no final sigma
        part, self.tail = self.tail + part, ""
        rules = _numbers()[1] if _has_numbers(part) else _PLAIN
        out: list[int] = []
        at = 0
        if self.kind and part:
            at = (rules.letters if self.kind == "letters" else rules.others).match(part).end()
            out += self._push(part[:at])
            if at < len(part):
                out += self._close()
        found = rules.words.findall(part, at)
        opened = found.pop() if found and not final and part.endswith(found[-1]) and not rules.number.fullmatch(found[-1]) else ""
        if opened == "'":
            self.tail = opened
        elif opened in ("r", "v", "l") and found and part.endswith("'" + opened):
            self.tail = found.pop() + opened
        elif len(opened) > 1 and opened[0] == "'" and opened[1].isalpha():
            found.append(opened)  # a contraction, which is closed
            opened = ""
        memory, long = self.memory, {}
        if len(memory) >= MEMORY:
            memory.clear()
        for word in set(found).difference(memory):
            (memory if len(word) <= SHORT else long)[word] = self.word(word)  # no word is open here
        out += chain.from_iterable(map(memory.__getitem__, found) if not long else (memory[w] if w in memory else long[w] for w in found))
        if opened and not self.tail:
            self.kind = "letters" if rules.letters.fullmatch(opened) else "others"
            out += self._push(opened)
        if final:
            out += self._close()
        return out


class Encoder:
    """Texts to ids; keeps the memory of short words from text to text."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.memory: dict[str, list[int]] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")

    def stream(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, a few at a time."""
        at = 0
        for found in chain(self.special.finditer(text), (None,)):
            end = found.start() if found else len(text)
            if at < end:
                transducer = Transducer(self.vocabulary, self.memory)
                for part in _slices(text, at, end):
                    yield transducer.feed(part)
                yield transducer.feed("", final=True)
            if found:
                yield [self.vocabulary.special[found[0]]]
                at = found.end()

    def ids(self, text: str | None) -> list[int]:
        return [i for part in self.stream(text or "") for i in part]


class Decoder:
    """Ids to text, incrementally: feed() gives the text that is complete, finish() what is left."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.begun = vocabulary, False
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")
        self.letters = None if vocabulary.joined else {c: b for b, c in enumerate(byte_letters())}

    def feed(self, ids: Iterable[int]) -> str:
        texts = self.vocabulary.texts
        if self.letters is None:
            out = " ".join(map(texts.__getitem__, ids))
            out, self.begun = (f" {out}" if self.begun and out else out), self.begun or bool(out)
            return out
        out = []
        for i in ids:
            token = texts[i]
            if token in self.vocabulary.special:
                out += [self.bytes.decode(b"", True), token]
                self.bytes.reset()
                continue
            end = bool(self.vocabulary.suffix) and token.endswith(self.vocabulary.suffix)
            token = token.removesuffix(self.vocabulary.suffix) if end else token
            out.append(self.bytes.decode(bytes(self.letters[c] for c in token)) + " " * end)
        return "".join(out)

    def finish(self) -> str:
        return "" if self.letters is None else self.bytes.decode(b"", True)


def digests(encoder: Encoder, text: str | None) -> tuple[int, str, str]:
    """Tokens, and the SHA-256 of the ids and of the text decoded from them, hashed as they come."""
    n, hashed, decoded = 0, hashlib.sha256(), hashlib.sha256()
    decoder, names = Decoder(encoder.vocabulary), encoder.vocabulary.names
    for ids in encoder.stream(text or ""):
        if ids:
            hashed.update((" " if n else "").encode() + " ".join(map(names.__getitem__, ids)).encode())
            decoded.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
            n += len(ids)
    decoded.update(decoder.finish().encode("utf-8", "surrogatepass"))
    return n, hashed.hexdigest(), decoded.hexdigest()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared: Broadcast) -> Encoder:
    """One encoder a worker and vocabulary, for all of its tasks."""
    key, text = shared.value
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(text))
    return _ENCODERS[key]


def _shared(docs: DataFrame, path: str) -> Broadcast:
    """The file's text, for all tasks: a vocabulary has a fixed size."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    return docs.sparkSession.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), text))


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs with ids (array of int) instead of the text."""
    shared = _shared(docs, path)
    return with_results(docs, lambda texts: [pa.array([_encoder(shared).ids(t) for t in texts], pa.list_(pa.int32()))], "ids array<int>", column)


def decode(rows: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """rows with text instead of the ids; null ids give the empty text."""
    shared = _shared(rows, path)

    def texts(batch) -> list[pa.Array]:
        vocabulary, out = _encoder(shared).vocabulary, []
        for ids in batch:
            decoder = Decoder(vocabulary)
            out.append(decoder.feed(ids or []) + decoder.finish())
        return [pa.array(out, pa.string())]

    return with_results(rows, texts, "text string", column)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 instead of the text."""
    shared = _shared(docs, path)

    def made(texts: list[str | None]) -> list[pa.Array]:
        rows = [digests(_encoder(shared), t) for t in texts]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return with_results(docs, made, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_streaming_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_path())
