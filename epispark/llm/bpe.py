"""BPE encoding and decoding by a tokenization automaton.

The automaton's states are "the last arc taken was token t"; its arcs are labelled with tokens. It
starts with one state that loops over the base symbols. Each merge (u, v) -> w, in the order of the
merge list, applies a gadget: the arc v leaves the state of u from now on, every state that has an
arc u gets an arc w, and w leads to the state that v leads to at that moment. After the last gadget
each sequence of symbols has exactly one path, its BPE tokenization, and so has each of its prefixes;
so the arc that ends a prefix is unique and encoding is one sweep over the word.

The gadgets' changes are kept as tables: ``cut[u][v]`` is the time at which arc v left u's state, and a
token's chains list the arcs it stands in for from the right and from the left, with the times until
which they are live. The arc w is present in the state of t unless one of the cuts hit a pair of arcs
that were live on both sides. The transition table (which arcs leave which state) has billions of places, of which a
corpus visits few, so its places are computed from these tables when they are first visited, and kept.
Encoding takes the longest arc that the state has, and steps back where that leads nowhere.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from epispark.llm.common import map_text

_NEVER, _DEAD = 1 << 60, -2
#: Words of up to this many characters are kept in a task's memory, this many at a time, and so many arcs.
_CACHED_CHARS, _CACHED_WORDS, _CACHED_ARCS = 48, 400_000, 300_000
#: Characters looked up at first where a token is sought.
_FIRST = 4
#: Below this code point Python's and the tokenizer's character tables agree.
_PLAIN = "԰"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte (the byte-level alphabet)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Automaton:
    """The deterministic automaton of a merge list over the tokens of a vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        self.end, self.ids = end, vocab
        self.labels = [""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.labels[i] = token
        self.cut: dict[int, dict[int, int]] = {}
        # chains as links: what a token was made of, and when (-1: a base symbol; _DEAD: no path has it)
        none = array("i", [_DEAD]) * len(self.labels)
        self.first, self.last, self.time = none[:], none[:], array("q", [_NEVER]) * len(self.labels)
        made = {u + v for u, v in merges}
        for token, i in vocab.items():
            if token not in made:
                self.first[i] = self.last[i] = -1
        for time, (u, v) in enumerate(merges):
            self._gadget(vocab[u], vocab[v], vocab[u + v], time)
        # live tokens that end a word, by what stands before the suffix, and the others; ``starts``: each string that
        # one of these begins with -> the longest of them that it begins with; ``shorter``: the same for a token less its end
        self.finals = {token[: len(token) - len(end)]: i for token, i in vocab.items() if self.last[i] != _DEAD and token.endswith(end)}
        inner = {token: i for token, i in vocab.items() if self.last[i] != _DEAD and not (end and token.endswith(end))}
        self.starts: dict[str, int] = {}
        self.shorter, self.size = array("i", [-1]) * len(self.labels), array("i", map(len, self.labels))
        for token in sorted(inner, key=len):
            best = -1
            for k in range(1, len(token)):
                best = self.starts.setdefault(token[:k], best)
            self.starts[token] = inner[token]
            self.shorter[inner[token]] = best
        self.known: dict[int, bool] = {}

    def _gadget(self, u: int, v: int, w: int, time: int) -> None:
        if _DEAD in (self.last[u], self.last[v]) or self.last[w] != _DEAD or not self._arc(u, v):
            return  # no path takes u and then v (any more): the merge can't apply
        self.cut.setdefault(u, {})[v] = time
        self.first[w], self.last[w], self.time[w] = u, v, time

    def _arc(self, state: int, token: int) -> bool:
        """Is there an arc ``token`` out of the state after ``state``?"""
        a, a_until = state, _NEVER
        while a >= 0:
            cuts = self.cut.get(a)
            if cuts:
                b, b_until = token, _NEVER
                while b >= 0:
                    time = cuts.get(b, _NEVER)
                    if time < a_until and time <= b_until and time != _NEVER:
                        return False
                    b, b_until = self.first[b], min(b_until, self.time[b])
            a, a_until = self.last[a], min(a_until, self.time[a])
        return True

    def arc(self, state: int, token: int) -> bool:
        """``_arc`` by table: computed once for each pair that occurs."""
        key = state << 32 | token
        found = self.known.get(key)
        if found is None:
            if len(self.known) > _CACHED_ARCS:
                self.known.clear()
            found = self.known[key] = self._arc(state, token)
        return found

    def encode(self, word: str) -> list[int]:
        """Token ids of a word of byte symbols.

        Takes the longest arc that the state allows and steps back where that leads nowhere. A position
        is entered at most once, as each prefix has one path, so the time is linear in the word.
        """
        n = len(word)
        if not n:
            return []
        whole = self.finals.get(word)
        if whole is not None:
            return [whole]
        finals, starts, known, arc = self.finals.get, self.starts.get, self.known.get, self.arc
        shorter, size = self.shorter, self.size
        path: list[int] = []
        at, state = 0, -1
        while True:
            token = finals(word[at:])
            if token is not None and (state < 0 or arc(state, token)):
                path.append(token)
                return path
            # the longest string that goes on here: most have a few characters
            j = min(at + _FIRST, n - 1)
            token = starts(word[at:j])
            if token is not None:
                while j < n - 1 and (longer := starts(word[at : j + 1])) is not None:
                    token, j = longer, j + 1
            else:
                while token is None and j - at > 1:
                    j -= 1
                    token = starts(word[at:j])
                if token is None:
                    token = -1
            while True:
                while token >= 0 and state >= 0:
                    live = known(state << 32 | token)
                    if live if live is not None else arc(state, token):
                        break
                    token = shorter[token]
                if token >= 0:
                    break
                if not path:
                    raise ValueError(f"no path for {word!r}: a symbol is not in the vocabulary")
                token = path.pop()
                at -= size[token]
                token, state = shorter[token], path[-1] if path else -1
            path.append(token)
            at += size[token]
            state = token


class Recent(dict):
    """What ``make`` returns by word, kept for the words asked for last: ``most`` of them, or down to half as many."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= _CACHED_CHARS:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Tokenizer:
    """A tokenizer file (BPE with word ends, byte level) whose BPE model runs as an automaton."""

    def __init__(self, file_text: str):
        self.file_text = file_text
        spec = json.loads(file_text)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = list(self.automaton.labels)
        for token, i in self.special.items():
            self.labels.extend([""] * (i + 1 - len(self.labels)))
            self.labels[i] = token
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.library = None
        self.chunk_ids, self.word_ids = Recent(self._chunk, _CACHED_WORDS // 4), Recent(self._word, _CACHED_WORDS)

    def _split(self, chunk: str) -> list[str]:
        """The pre-split words of a run without white space, as byte symbols."""
        if chunk.isascii() or max(chunk) < _PLAIN:
            chunk = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            symbols = self.symbols
            return [w if w.isascii() and w.isprintable() else "".join([symbols[b] for b in w.encode()]) for w in self.words.findall(chunk)]
        if self.library is None:  # newer scripts: the character tables of the tokenizer's own normaliser decide
            import tokenizers

            self.library = tokenizers.Tokenizer.from_str(self.file_text)
        chunk = self.library.normalizer.normalize_str(chunk)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.word_ids.__getitem__, self._split(chunk)))

    def _word(self, word: str) -> bytes:
        return array("i", self.automaton.encode(word)).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        parts = self.cut.split(text) if self.cut and any(x in text for x in self.special) else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype=np.int32).tobytes())
            else:
                chunks = regex.split(r"\s+", part) if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()
                out += map(self.chunk_ids.__getitem__, chunks)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other; this file has no decoder, so spaces join them."""
        return " ".join(map(self.labels.__getitem__, ids))


def read_tokenizer(path: str) -> str:
    """The text of a tokenizer file on the driver; tasks get it from there (1-2 MB, fixed)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_LOADED: dict[int, Tokenizer] = {}


def _loaded(file_text: str) -> Tokenizer:
    key = hash(file_text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(file_text)
    return _LOADED[key]


def _id_lists(tokenizer: Tokenizer, texts: list[str]) -> pa.Array:
    parts = [tokenizer.encode_bytes(t) for t in texts]
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def _texts(tokenizer: Tokenizer, lists: pa.Array) -> pa.Array:
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)).tolist()
    return pa.array([tokenizer.decode(ids[a:b].tolist()) for a, b in zip([0, *ends], ends)], pa.string())


def bpe_encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``ids`` (array of int): the tokens of each whole text; leave out the columns in ``drop``. No shuffle.

    Nulls: a null text counts as empty; empty texts have no ids. Very long texts are encoded whole, in
    linear time. Repeated rows get the same ids. Extra columns pass through; one named like ``ids_col``
    is replaced. Strings of special tokens in a text become those tokens, as in the library.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def make():
        tokenizer = _loaded(shared.value)
        return lambda texts: [_id_lists(tokenizer, texts)]

    return map_text(df, [text_col], [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make, drop)


def bpe_decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add ``decoded``: the arc labels of each row's ids. No shuffle.

    Null or empty ids decode to the empty string; an id outside the vocabulary is an error. Extra
    columns pass through; one named like ``decoded_col`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    kept = [f for f in df.schema.fields if f.name != decoded_col]
    schema = T.StructType(kept + [T.StructField(decoded_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [_texts(tokenizer, batch.column(ids_col))], [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, tokenizer_path: str, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Encode, then decode what was encoded: columns ``ids`` and ``decoded``. As ``bpe_encode``, then ``bpe_decode``, but in
    the same Python worker, which holds the tables once."""
    shared = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def make():
        tokenizer = _loaded(shared.value)

        def run(texts):
            ids = _id_lists(tokenizer, texts)
            return [ids, _texts(tokenizer, ids)]

        return run

    return map_text(df, [text_col], [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], make, drop)


def default_tokenizer() -> str:
    """The tokenizer file that the queries use where none is named."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
