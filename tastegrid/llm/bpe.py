"""BPE encoding and decoding by bounded-lookahead streaming transducers.

Encoding. A merge list has a sufficient lookahead: two texts that agree on their first n symbols agree on every
token that ends at least that many symbols before n. The transducer keeps the symbols of a word it has not
settled, merges them, emits the tokens that end that far before the end, and forgets them: its memory is the
lookahead and one block, however long the word. Texts are read in windows cut where neither normalisation nor
splitting can look across. Words of ordinary length are kept in a bounded memo.

Decoding. A state machine takes ids and emits text: as token strings with one space between, as the library
does for a file without a decoder, or as text, with bytes that do not yet make a character held back.

The file's form: NFC, white space to one space, lower case; words split by contractions, letters, single
numbers and other runs; byte symbols with a word-end suffix; special tokens cut out first.

Cases: a null or empty text has no tokens and decodes to the empty string; white space alone has no tokens; a
special token inside a text gives its id; a very long text or word is coded in windows and pieces, and only its
ids and what they decode to are held whole; a tokenizer file of another form raises; repeated rows are coded alike; an empty table gives an empty result;
extra columns pass through unless they carry an output name.
"""

from __future__ import annotations

import codecs
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import parts, released

#: Characters of a text window and of a word that the memo takes; bytes of each of the memo's two generations;
#: symbols merged at once.
WINDOW_CHARS = 1 << 16
MEMO_WORD = 64
MEMO_BYTES = 16 << 20
BLOCK = 1 << 12
#: Bytes that an entry of the memo takes besides the letters and ids: two objects' heads and a place in the table.
ENTRY_BYTES = 200
#: Bytes of text that one Arrow batch of results stands for.
BATCH_BYTES = 1 << 20

WHITE = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(rest.get(b, b)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols from the end beyond which no continuation changes a token.

    Run the merges by rank over two texts with a common start. What they agree on shrinks only when a merge
    (u, v) takes the last agreed token u in one of them: by the length of u. The merge that shrinks it next has
    a higher rank and a right part that begins with u, as the token there does from then on. The longest such
    chain, by the lengths of its left parts, bounds what can be lost in all.
    """
    longest: dict[str, int] = {}
    length = lambda token: len(token.removesuffix(suffix)) if suffix else len(token)
    most = 0
    for u, v in merges:
        chain = length(u) + max((longest[v[:i]] for i in range(1, len(v) + 1) if v[:i] in longest), default=0)
        longest[u] = max(longest.get(u, 0), chain)
        most = max(most, chain)
    return most


def unicode_class(kinds: str) -> str:
    """A regular-expression class body of the characters whose category begins with one of kinds."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in kinds
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Merges:
    """The merge table of a tokenizer file."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.vocab: dict[str, int] = model["vocab"]
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        made: dict[str, int] = {}
        for i, (u, v) in enumerate(pairs):
            if made.get(u, -1) > i or made.get(v, -1) > i:
                raise ValueError("a merge stands before the merges of its parts")
            made.setdefault(u + v, i)
        self.lookahead = sufficient_lookahead(pairs, self.suffix)
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.bytes = {s: bytes([b]) for b, s in enumerate(byte_symbols())}

    def merged(self, symbols: list[str]) -> list[str]:
        """symbols after all merges, lowest rank first."""
        if len(symbols) > 100:
            return self._merged_long(symbols)
        get, never = self.ranks.get, len(self.ranks)
        due = [get(p, never) for p in zip(symbols, symbols[1:], strict=False)]
        while due:
            best = min(due)
            if best == never:
                break
            i = due.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del due[i]
            if i:
                due[i - 1] = get((symbols[i - 1], symbols[i]), never)
            if i < len(due):
                due[i] = get((symbols[i], symbols[i + 1]), never)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        ranks, n = self.ranks, len(symbols)
        symbols, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get(p)) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, (u, v) = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != u or j < 0 or symbols[j] != v:
                continue
            symbols[i], symbols[j], after[i] = u + v, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(queue, (r, a, (symbols[a], symbols[b])))
        return [s for s in symbols if s]


class WordTransducer:
    """Tokens of one word whose symbols come in pieces."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.pending = merges, []

    def feed(self, symbols: Iterable[str]) -> list[str]:
        """The tokens that no continuation can change any more."""
        self.pending.extend(symbols)
        out: list[str] = []
        keep = self.merges.lookahead + 1  # the last symbol may yet get the suffix
        while len(self.pending) > keep + BLOCK:
            head = self.pending[: keep + BLOCK]
            settled, end = [], 0
            for token in self.merges.merged(head[:-1]):
                if end + len(token) > len(head) - keep:
                    break
                settled.append(token)
                end += len(token)
            out += settled
            del self.pending[:end]
        return out

    def finish(self) -> list[str]:
        last, self.pending = self.pending, []
        return self.merges.merged([*last[:-1], last[-1] + self.merges.suffix]) if last else []


class Memo(dict):
    """word -> its ids as little-endian int32 bytes. A full memo becomes the old one, from which words that come
    again are taken over: what is common stays, and two generations of MEMO_BYTES bound the memory."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.old, self.held = encoder, {}, 0

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word) or self.encoder.word_ids(word)
        if len(word) <= MEMO_WORD:
            if self.held >= MEMO_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self[word] = found
            self.held += ENTRY_BYTES + len(word) + len(found)
        return found


#: The form of file that the encoder reads (fixed values of the format): how texts are normalised and split.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def check_form(spec: dict) -> None:
    """Raises unless the file has the form that this encoder is made for; any other would be encoded wrongly."""
    model, splits = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    form = [
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZER,
        [p.get("type") for p in splits] == ["Split", "ByteLevel"] and splits[0].get("pattern") == SPLITTER and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True,
        len(splits) == 2 and not splits[1].get("add_prefix_space") and splits[1].get("use_regex") is False,
        not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
        spec.get("decoder") is None,
    ]
    if not all(form):
        raise ValueError("this tokenizer file has another form than the encoder reads")


class Encoder:
    """Streams text to ids."""

    def __init__(self, spec: dict, letters: str, numbers: str) -> None:
        import re

        self.merges = Merges(spec)
        # a contraction begins with no letter, so it does not matter that letters are tried first
        self.words = re.compile(f"[{letters}]+|{CONTRACTIONS}|[{numbers}]|[^{WHITE}{letters}{numbers}]+")
        # the same for texts of Latin-1, whose classes are small and quick to look up
        few = ["".join(f"\\x{c:02x}" for c in range(256) if re.match(f"[{x}]", chr(c))) for x in (letters, numbers, WHITE)]
        self.latin_words = re.compile(f"[{few[0]}]+|{CONTRACTIONS}|[{few[1]}]|[^{few[2]}{few[0]}{few[1]}]+")
        self.kinds = [re.compile(f"[{letters}]+"), None, re.compile(f"[^{WHITE}{letters}{numbers}]+")]
        self.letter = re.compile(f"[{letters}]")
        self.number = re.compile(f"[{numbers}]")
        self.white = re.compile(f"[{WHITE}]")
        self.symbols = byte_symbols()
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.starts = {s[:i] for s in special for i in range(1, len(s))}
        self.longest = max(map(len, special), default=0)
        self.memo = Memo(self)

    def word_symbols(self, word: str) -> list[str]:
        return [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]

    def word_ids(self, word: str) -> bytes:
        machine = WordTransducer(self.merges)
        return self._pack(machine.feed(self.word_symbols(word)) + machine.finish())

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter, so no final sigma

    def _inert(self, c: str) -> bool:
        """Neither composes with what stands before it nor is moved before it."""
        return c.isascii() or (unicodedata.combining(c) == 0 and unicodedata.category(c)[0] in "LNZPS" and not "ᅠ" <= c <= "ᇿ")

    def _windows(self, text: str) -> Iterator[str]:
        """Parts of a text that normalise each on their own."""
        start = 0
        while len(text) - start > WINDOW_CHARS:
            cut = start + WINDOW_CHARS
            for c in range(cut, start + WINDOW_CHARS // 2, -1):
                if self.white.match(text[c]):
                    cut = c
                    break
            while cut < len(text) and not self._inert(text[cut]):
                cut += 1
            yield text[start:cut]
            start = cut
        yield text[start:]

    def _plain(self, text: str) -> Iterator[bytes]:
        """ids of a text without special tokens, a window at a time; a word open at a window's end goes on."""
        if len(text) <= WINDOW_CHARS:
            text = self.normal(text)
            words = self.latin_words if text.isascii() or max(text) < "\u0100" else self.words
            yield b"".join(map(self.memo.__getitem__, words.findall(text)))
            return
        held, word, kind = "", None, 0
        for window in self._windows(text):
            part = held + self.normal(window)
            held = ""
            if word is not None:
                more = self.kinds[kind].match(part)
                end = more.end() if more else 0
                yield self._pack(word.feed(self.word_symbols(part[:end])))
                if end == len(part):
                    continue
                yield self._pack(word.finish())
                part, word = part[end:], None
            before = last = None
            for m in self.words.finditer(part):
                if before is not None:
                    yield self.memo[before.group()]
                before, last = last, m
            if last is None:
                continue
            # an apostrophe before the last word may yet begin a contraction with it
            joined = before is not None and before.group() == "'" and before.end() == last.start() and last.end() == len(part)
            if before is not None and not joined:
                yield self.memo[before.group()]
            if last.end() < len(part):
                yield self.memo[last.group()]
            elif last.end() - last.start() <= MEMO_WORD:
                held = ("'" if joined else "") + last.group()
            else:
                if joined:
                    yield self.memo["'"]  # a contraction would have been taken
                kind = 0 if self.letter.match(last.group()) else 2
                word = WordTransducer(self.merges)
                yield self._pack(word.feed(self.word_symbols(last.group())))
        if word is not None:
            yield self._pack(word.finish())
        if held:
            yield b"".join(map(self.memo.__getitem__, self.words.findall(held)))

    def _pack(self, tokens: list[str]) -> bytes:
        return b"".join(map(self.merges.packed.__getitem__, tokens))

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text as little-endian int32, in pieces."""
        text, start = text or "", 0
        if self.special and "<" in text or self.special and any(s[0] != "<" for s in self.merges.special):
            for m in self.special.finditer(text):
                yield from self._plain(text[start : m.start()])
                yield np.array([self.merges.special[m.group()]], dtype="<i4").tobytes()
                start = m.end()
        yield from self._plain(text[start:] if start else text)


class Decoder:
    """Turns ids into text as they come. as_text: bytes and word ends undone; else token strings and spaces."""

    def __init__(self, merges: Merges, as_text: bool = False) -> None:
        self.merges, self.as_text, self.started = merges, as_text, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def _bytes(self, token: str) -> bytes:
        if token in self.merges.special:
            return token.encode()
        ends = self.merges.suffix and token.endswith(self.merges.suffix)
        body = token.removesuffix(self.merges.suffix) if ends else token
        return b"".join(self.merges.bytes[c] for c in body) + (b" " if ends else b"")

    def feed(self, ids: Iterable[int]) -> str:
        if self.as_text:
            return "".join(self.utf8.decode(self._bytes(self.merges.names[i])) for i in ids)
        text = " ".join(map(self.merges.names.__getitem__, ids))
        if not text:
            return ""
        text, self.started = (" " + text if self.started else text), True
        return text

    def finish(self) -> str:
        return self.utf8.decode(b"", True) if self.as_text else ""


@lru_cache(maxsize=2)
def classes() -> tuple[str, str]:
    return unicode_class("L"), unicode_class("N")


_coders: dict[str, Encoder] = {}


def _coder(key: str, spec) -> Encoder:
    """One encoder a worker process and tokenizer file; spec is a broadcast of the file's tables, a fixed size."""
    if key not in _coders:
        _coders.clear()
        _coders[key] = Encoder(*spec.value)
    return _coders[key]


def coded(docs: DataFrame, path: str, *, text: str = "text", decode: bool = True) -> DataFrame:
    """docs with n_tokens, ids and, if decode, decoded: what the ids decode to."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    check_form(form)
    spec = spark.sparkContext.broadcast((form, *classes()))
    added = ["n_tokens", "ids", *(["decoded"] if decode else [])]
    kept = [f for f in docs.schema.fields if f.name not in added]
    source = docs.select(*[f"`{f.name}`" for f in kept])
    at = [f.name for f in kept].index(text)

    def run(batches):
        encoder = _coder(path, spec)
        for batch in batches:
            for part in parts(batch, at, BATCH_BYTES):
                rows, decoded = [], []
                for t in part.column(at).to_pylist():
                    machine, pieces, shown = Decoder(encoder.merges), [], []
                    for piece in encoder.encode(t):
                        pieces.append(piece)
                        if decode:
                            shown.append(machine.feed(np.frombuffer(piece, dtype="<i4").tolist()))
                    rows.append(b"".join(pieces))
                    decoded.append("".join(shown) + machine.finish())
                counts = np.array([len(r) // 4 for r in rows], dtype=np.int64)
                flat = np.frombuffer(b"".join(rows), dtype="<i4")
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat))
                columns = [*part.columns, pa.array(counts), ids, *([pa.array(decoded, pa.string())] if decode else [])]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + added)

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

    schema = StructType(list(kept)).add("n_tokens", LongType()).add("ids", ArrayType(IntegerType(), False))
    return source.mapInArrow(released(run), schema.add("decoded", StringType()) if decode else schema)
