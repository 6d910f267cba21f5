"""BPE encoding by a bounded-lookahead transducer, decoding by a byte-to-text state machine."""

from __future__ import annotations

import array
import codecs
import functools
import gc
import json
import unicodedata
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shapelog.llm.common import released, ship

#: White space of the tokenizer files' patterns; str.split() also splits at x1c-x1f.
_SPACES = regex.compile(r"[\t-\r\x20\x85\p{Z}]+")
_ODD = regex.compile(r"[\x1c-\x1f]")
#: Chunks (text between white space) and words that a worker keeps encoded, in each of two generations.
KEPT, KEPT_WORDS = 350_000, 200_000
#: Up to this code point all versions of Unicode say the same of letters, case and composition.
SETTLED = "\u02ff"
#: Longest chunk that is kept.
KEPT_CHARS = 64
#: Characters of a text that are split into chunks at a time.
STEP = 1 << 16

_OUT = pa.schema([("row", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.large_string())])


@functools.cache
def byte_chars() -> tuple[str, ...]:
    """The printable stand-in of each byte in byte-level vocabularies, by their rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return tuple(chr(b) if b in shown else chr(next(spare)) for b in range(256))


class Merges:
    """Vocabulary and merge list of a tokenizer file, and which tokens may be neighbours."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        #: A final token spans at most so many symbols: among the encodings of the
        #: last ``lookahead`` prefixes is the start of the final encoding.
        self.lookahead = max(len(self._symbols(t)) for t in self.vocab)
        bodies = [t.removesuffix(self.suffix) if self.suffix else t for t in self.vocab]
        self.beginnings = {b[:n] for b in bodies for n in range(1, len(b) + 1)}
        self.never = len(self.ranks)
        self._fits, self._known, self._edges = {}, 0, {}

    def _symbols(self, token):
        """A token as the symbols that it merges; the suffix belongs to the last one."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, symbols):
        """The encoding by definition: the first merge of the list, leftmost, again and again."""
        parts = list(symbols)
        while len(parts) > 1:
            ranked = [(self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spines(self, token):
        """A token's right edge and left edge, or None if no word is encoded as this token.

        Each is (part, rank of the merge that takes the part in), innermost part first;
        the token itself is taken in by none.
        """
        known = self._edges.get(token, self)
        if known is not self:
            return known
        parts, before = self._symbols(token), None
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, self.never), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == self.never:
                break
            before, parts = (parts, rank), [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        if len(parts) > 1:
            made = None
        elif before is None:
            made = ([(token, self.never)], [(token, self.never)])
        else:
            (left, right), rank = before
            made = tuple(
                [*self._spines(part)[side][:-1], (part, rank), (token, self.never)]
                for side, part in ((0, right), (1, left))
            )
        self._edges[token] = made
        return made

    def _keep_apart(self, left, right):
        """Whether merging never joins parts of both tokens.

        Both are built up in the order of ranks. While the parts at the seam stand
        side by side, a merge of the two must not come before the one that takes
        either of them in; of one rank, the leftmost pair merges first.
        """
        edge, other = self._spines(left), self._spines(right)
        if edge is None or other is None:
            return False
        edge, other, i, j = edge[0], other[1], 0, 0
        while True:
            (a, until), (b, till) = edge[i], other[j]
            rank = self.ranks.get((a, b), self.never)
            if rank < until and rank <= till and rank < self.never:
                return False
            if until == till == self.never:
                return True
            if until <= till:
                i += 1
            else:
                j += 1

    def after(self, left):
        """What is known of ``fits`` for this left token, by the right one."""
        row = self._fits.get(left)
        if row is None:
            if self._known > 1_000_000:
                self._fits, self._known = {}, 0
            row = self._fits[left] = {}
        return row

    def fits(self, left, right):
        """Whether ``left right`` is the encoding of their joined symbols (left None: of right alone)."""
        row = self.after(left)
        known = row.get(right)
        if known is None:
            known = self._spines(right) is not None if left is None else self._keep_apart(left, right)
            row[right] = known
            self._known += 1
        return known


class Transducer:
    """Encode one word symbol by symbol with bounded memory.

    A token sequence is the encoding of a word exactly if every two neighbours are
    the encoding of their own symbols. So the encoding of a prefix is its last token
    and the encoding of what comes before; each prefix keeps that last token and a
    link. A token of the final result ends within the next ``lookahead`` symbols, so
    only that many prefixes stay open. What all of them share is stable and is
    emitted. Open prefixes agree some tokens back, whatever the word's length.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.symbols = []
        self.ends = [(None, None, 0)]  # (token, link to the prefix before, its end), oldest first
        self.done = 0  # end of what has been emitted
        self.at = 0

    def feed(self, symbol: str) -> None:
        """Take one more symbol; nothing is returned before ``stable`` or ``finish``."""
        m, ends = self.merges, self.ends
        self.at += 1
        self.symbols.append(symbol)
        if len(self.symbols) > m.lookahead:
            del self.symbols[0]
        chosen = None
        for n in range(min(len(ends), len(self.symbols)), 0, -1):
            before = ends[-n]
            token = "".join(self.symbols[-n:])
            if before is not None and token in m.vocab and m.fits(before[0], token):
                chosen = (token, before, self.at)
                break
        ends.append(chosen)
        if len(ends) > m.lookahead + 1:
            del ends[0]

    def stable(self) -> list[str]:
        """Tokens that no further symbol can change, each once."""
        paths = []
        for end in self.ends:
            if end is not None:
                paths.append(self._path(end))
        common = []
        for tokens in zip(*paths):
            if any(t[2] != tokens[0][2] for t in tokens):
                break
            common.append(tokens[0])
        if common:
            last = common[-1]
            self.done = last[2]
            self.ends = [self._cut(e, last) for e in self.ends]
        return [t[0] for t in common]

    def _path(self, end):
        """Tokens of a prefix after what has been emitted, first to last."""
        path = []
        while end[1] is not None and end[2] > self.done:
            path.append(end)
            end = end[1]
        return path[::-1]

    def _cut(self, end, last):
        """The same prefix with its links cut at ``last``."""
        if end is None:
            return None
        made = (last[0], None, last[2])
        for token in self._path(end):
            made = (token[0], made, token[2])
        return made

    def finish(self) -> list[str]:
        """The remaining tokens, the word being over."""
        return [t[0] for t in self._path(self.ends[-1])]


def within_window(m: Merges, shown: str) -> list[int]:
    """The same recurrence for a word no longer than the lookahead: all its prefixes stay open.

    From each prefix that is reached all tokens that begin there are tried; the first
    that fits is a prefix's last token.
    """
    vocab, fits, beginnings = m.vocab, m.fits, m.beginnings
    n = len(shown)
    last, start = [None] * (n + 1), [-1] * (n + 1)
    for j in range(n):
        left = last[j]
        if left is None and j:
            continue
        row = m.after(left)
        for i in range(j + 1, n + 1):
            token = shown[j:i]
            if token not in beginnings:
                break
            if last[i] is None:
                if i == n:
                    token += m.suffix
                if token in vocab:
                    good = row.get(token)
                    if good or good is None and fits(left, token):
                        last[i], start[i] = token, j
    out = []
    while n:
        out.append(vocab[last[n]])
        n = start[n]
    return out[::-1]


def _library(spec):
    """The library's own normalizer and splitting of a tokenizer file, without its copy of vocabulary and merges."""
    model = {"type": "BPE", "vocab": {}, "merges": []}
    bare = Tokenizer.from_str(json.dumps(spec | {"model": model, "added_tokens": [], "post_processor": None}))
    return bare.normalizer, bare.pre_tokenizer


class Encoder:
    """Texts to token ids as the tokenizer file says."""

    def __init__(self, text: str, kept: int = KEPT):
        self.merges = Merges(text)
        spec = json.loads(text)
        self._check(spec)
        self.normalizer, self.splitter = _library(spec)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # Inside a set the white space of the pattern language is written out.
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\t-\r\x20\x85\p{Z}"))
        names = sorted(map(regex.escape, self.merges.special), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(names)})") if names else None
        self.chars = byte_chars()
        self.kept = _Kept(self.chunk, kept)
        self.kept_words = _Kept(lambda w: array.array("i", self.word(w)).tobytes(), kept * KEPT_WORDS // KEPT)

    @staticmethod
    def _check(spec):
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        steps = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if (
            kinds != ["NFC", "Replace", "Lowercase"]
            or steps != ["Split", "ByteLevel"]
            or spec["pre_tokenizer"]["pretokenizers"][1]["use_regex"]
            or not spec["model"].get("end_of_word_suffix")
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            raise ValueError("a tokenizer file of another kind")

    def word(self, word: str):
        """Ids of one word, emitted as they become stable."""
        m = self.merges
        plain = word.isascii() and word.isprintable()  # these bytes stand for themselves
        shown = word if plain else "".join([self.chars[b] for b in word.encode("utf-8")])
        if len(shown) <= m.lookahead:
            return within_window(m, shown)
        return self.long_word([*shown[:-1], shown[-1] + m.suffix])

    def long_word(self, symbols):
        m = self.merges
        run = Transducer(m)
        for i, symbol in enumerate(symbols, 1):
            run.feed(symbol)
            if i % (4 * m.lookahead) == 0:
                yield from (m.vocab[t] for t in run.stable())
        yield from (m.vocab[t] for t in run.finish())

    def chunk(self, chunk: str) -> bytes:
        """Ids of text without white space, as packed 32-bit numbers."""
        if not chunk.isascii() and max(chunk) > SETTLED:
            return b"".join([self.kept_words[w] for w in self._split(chunk)])
        plain = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        return b"".join([self.kept_words[w] for w in self.words.findall(plain.lower())])

    def _split(self, chunk):
        """Words of a chunk by the library's own normalizer and splitting.

        Which code points are letters, compose or have a lower case depends on the version
        of Unicode; this interpreter's is another one than the library's.
        """
        low = self.normalizer.normalize_str(chunk)
        return [low[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(low)]

    def stream(self, text: str):
        """Packed ids of a whole text, one step after the other."""
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                yield array.array("i", [self.merges.special[part]]).tobytes()
                continue
            odd = _ODD.search(part)
            for step in _steps(part):
                chunks = filter(None, _SPACES.split(step)) if odd else step.split()
                yield b"".join(map(self.kept.__getitem__, chunks))

    def packed(self, text: str) -> bytes:
        return b"".join(self.stream(text))

    def encode(self, text: str) -> array.array:
        return array.array("i", self.packed(text))


class _Kept(dict):
    """What has been encoded, bounded: when full it becomes the older generation, looked up once more."""

    def __init__(self, encode, limit):
        super().__init__()
        self.encode, self.limit, self.older = encode, limit, {}

    def __missing__(self, text):
        ids = self.older.get(text)
        if ids is None:
            ids = self.encode(text)
        if len(text) <= KEPT_CHARS:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


def _steps(text):
    start = 0
    while len(text) - start > STEP:
        found = _SPACES.search(text, start + STEP)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


class Decoder:
    """Token ids to text, a few at a time.

    ``library``: what the tokenizers library gives for a file without a decoder,
    the tokens' own strings with a blank between. ``text``: the bytes that the
    tokens stand for, read as UTF-8; the state is the unfinished character and
    whether a word has ended.
    """

    def __init__(self, merges: Merges, form: str = "library"):
        self.names, self.form = merges.names, form
        self.special, self.suffix = merges.special, merges.suffix
        # Made per text, so only where it is used.
        self.bytes = {c: b for b, c in enumerate(byte_chars())} if form == "text" else {}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.gap = False

    def feed(self, ids) -> str:
        if self.form == "library":
            out = " ".join(map(self.names.__getitem__, ids))
            if self.gap and len(ids):
                out = " " + out
            self.gap = self.gap or len(ids) > 0
            return out
        out = []
        for i in ids:
            name = self.names[i]
            if self.gap:
                out.append(" ")
            self.gap = name in self.special or name.endswith(self.suffix)
            if name in self.special:
                out.append(self.state.decode(b"", final=True) + name)
                continue
            body = name[: -len(self.suffix)] if self.gap else name
            out.append(self.state.decode(bytes(self.bytes[c] for c in body), final=self.gap))
        return "".join(out)

    def finish(self) -> str:
        return "" if self.form == "library" else self.state.decode(b"", final=True)


_LOADED = {}


def _encoder(text, kept) -> Encoder:
    if (text, kept) not in _LOADED:
        _LOADED.clear()
        _LOADED[text, kept] = Encoder(text, kept)
    return _LOADED[text, kept]


def encode(
    docs: DataFrame, tokenizer: str, decode: str | None = None, kept: int = KEPT, resident: bool = True
) -> DataFrame:
    """``docs`` with ``ids`` (array of int), and ``decoded`` if a form of ``Decoder`` is named.

    ``tokenizer`` is the path of a tokenizer file on the driver; its text goes to the
    executors as one broadcast of that file's size. Null and empty texts have no
    ids. All rows and other columns stay, repeated rows too; a column already named
    ``ids`` or ``decoded`` is replaced. An empty table gives an empty result. A text
    of any length is encoded whole: only its words in work are held, and its ids. A
    worker keeps up to ``kept`` chunks encoded in each of two generations, some 300 bytes
    each with their words; fewer cost time, more cost memory, and ids are the same. Workers
    outlive their tasks: if ``resident``, one keeps all this for its next task; if not, each
    task loads the tokenizer anew, and other work of the session has that memory.
    """
    with open(tokenizer, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    ship(docs.sparkSession)
    columns_kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in columns_kept] + ["ids array<int>"] + ["decoded string"] * bool(decode))

    text = columns_kept.index("text")

    def run(batches_in):
        encoder = _encoder(model.value, kept)
        for batch in batches_in:
            for start, stop in _portions(batch.column(text)):
                part = batch.slice(start, stop - start)
                ids = [encoder.packed(t.as_py() or "") for t in part.column(text)]
                columns = list(part.columns)
                offsets = pa.array([0, *_sums(len(x) // 4 for x in ids)], pa.int32())
                flat = b"".join(ids)
                values = pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)])
                columns.append(pa.ListArray.from_arrays(offsets, values))
                if decode:
                    columns.append(pa.array([_decoded(encoder.merges, array.array("i", x), decode) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=columns_kept + ["ids", "decoded"][: 1 + bool(decode)])
        if not resident:
            del encoder
            _LOADED.clear()
            gc.collect()  # its parts refer to each other

    return docs.select(*[F.col(f"`{c}`") for c in columns_kept]).mapInArrow(released(run), schema)


def _decoded(merges, ids, form):
    decoder = Decoder(merges, form)
    out = [decoder.feed(ids[i : i + STEP]) for i in range(0, len(ids), STEP)]
    return "".join([*out, decoder.finish()])


def _sums(numbers):
    total = 0
    for n in numbers:
        total += n
        yield total


def _portions(texts, size=1 << 20):
    """Ranges of rows with about ``size`` characters: output batches hold a text, its ids and what they decode to."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text.as_py() or "")
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
