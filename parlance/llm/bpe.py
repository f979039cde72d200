"""BPE encoding and decoding by a tokenization automaton.

The automaton reads *tokens*: it accepts exactly the token sequences that BPE produces.  It starts
with one state and an arc for each base symbol, and every merge (a, b) -> c, in rank order, applies
one gadget: the state behind `a` is replaced by a copy without its `b` arc, and a `c` arc to the
state behind `b` is added wherever an `a` arc left at that moment.  So each token has one state of
its own, a copy of its right part's state.  The compiled automaton is a set of arrays: for each
state the part that it copies and the gadget that made it, and the sorted list of the arcs that
gadgets cut (a state's own ones; it shares those of the state it copies, up to its own gadget).
The arcs themselves are not written out (49k x 49k): `Automaton.arcs` decides many of them at once
and a table of fixed size keeps what was decided.

Encoding reads the symbols of all new words of a slice of texts together, one position at a time.  A
second deterministic table (Aho-Corasick over the tokens' spellings) gives the tokens that end at
each position, and exactly one of them continues the accepted sequence of the shorter prefix: the
automaton's arcs pick it.  Decoding emits the arc labels, i.e. the tokens' strings.

`TextCodec` does the rest of the tokenizer file: special tokens, NFC, white space, lower case, the
pre-split pattern and byte characters.  Each distinct white-space separated chunk of a slice of texts
(`SLICE_CHARS`) is split and encoded once; nothing but the decided arcs is kept between slices.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import enter, held, read_table

TOKENIZER = "word_bpe_49k.json"
END = "</w>"
#: Slots of the table of decided arcs (the newest of a slot stays).
ARC_BITS = 20
#: Words that are read together, and the longest one (in bytes) that is read with others.
WORDS_AT_ONCE, LONG_WORD = 8192, 64
#: Characters of texts that are encoded together (a longer text is alone).
SLICE_CHARS = 2_000_000
#: Arcs that the reading of a long word keeps.
LONG_ARCS = 100_000


def tokenizer_json(name: str = TOKENIZER) -> str:
    """The tokenizer file's text, read on the driver (its path is not assumed on executors)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Automaton:
    """Token automaton of a merge list; symbols are bytes 0-255 and, at a word's end, 256 + byte."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int]):
        chars = byte_characters()
        self.symbol = {c: b for b, c in enumerate(chars)} | {c + END: 256 + b for b, c in enumerate(chars)}
        self.label = {i: s for s, i in vocab.items()}
        self.base = {vocab[s]: sym for s, sym in self.symbol.items() if s in vocab}
        self.merge_step: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}     # token -> left, right, step
        spelling = {t: (s,) for t, s in self.base.items()}
        for step, (a, b) in enumerate(merges):               # one gadget per merge
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if left in spelling and right in spelling and self.has_arc(left, right, step):
                self.parts[made] = (left, right, step)
                spelling[made] = spelling[left] + spelling[right]
                self.merge_step[left, right] = step
        self._compile(len(self.label))
        self._spell(spelling)

    def is_cut(self, state: int, token: int, steps: int) -> bool:
        """Whether the first `steps` gadgets removed the token's arc from the state."""
        while True:
            if self.merge_step.get((state, token), steps) < steps:
                return True
            if state not in self.parts:
                return False
            _, state, made = self.parts[state]
            steps = min(steps, made)

    def has_arc(self, state: int, token: int, steps: int) -> bool:
        """Whether the token's arc leaves the state after the first `steps` gadgets."""
        while True:
            if self.is_cut(state, token, steps):
                return False
            if token not in self.parts:
                return True
            token, _, made = self.parts[token]
            if made >= steps:
                return False
            steps = made + 1

    def _compile(self, states: int) -> None:
        """The automaton as arrays: copied part, left part and gadget of each state; cut arcs, sorted."""
        self.left, self.right = np.zeros(states, np.int64), np.zeros(states, np.int64)
        self.made = np.full(states, -1, np.int64)            # -1: a base symbol
        for token, (left, right, step) in self.parts.items():
            self.left[token], self.right[token], self.made[token] = left, right, step
        cuts = sorted((a << 20 | b, step) for (a, b), step in self.merge_step.items())
        # a sentinel at the end, so that every search finds a place
        self.cut_arc = np.array([c for c, _ in cuts] + [1 << 62], np.int64)
        self.cut_step = np.array([s for _, s in cuts] + [0], np.int64)
        self.decided = np.full(1 << ARC_BITS, -1, np.int64)  # arc << 1 | whether it exists

    def _cuts(self, state: np.ndarray, token: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """`is_cut` of many arcs."""
        cut, at = np.zeros(len(state), bool), np.arange(len(state))
        while len(at):
            arc = state << 20 | token
            place = np.searchsorted(self.cut_arc, arc)
            hit = (self.cut_arc[place] == arc) & (self.cut_step[place] < steps)
            cut[at[hit]] = True
            made = self.made[state]
            on = ~hit & (made >= 0)
            at, token, steps = at[on], token[on], np.minimum(steps, made)[on]
            state = self.right[state[on]]
        return cut

    def _exist(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """`has_arc` of many arcs of the finished automaton."""
        there, at = np.zeros(len(state), bool), np.arange(len(state))
        steps = np.full(len(state), 1 << 30, np.int64)
        while len(at):
            cut = self._cuts(state, token, steps)
            made = self.made[token]
            there[at[~cut & (made < 0)]] = True
            on = ~cut & (made >= 0) & (made < steps)
            at, state, steps, token = at[on], state[on], made[on] + 1, self.left[token[on]]
        return there

    def arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the tokens' arcs leave the states; the table keeps the answers."""
        arc = state << 20 | token
        slot = (arc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - ARC_BITS)).view(np.int64)
        have = self.decided[slot]
        there = (have & 1) == 1
        new = np.flatnonzero(have >> 1 != arc)
        if len(new):
            there[new] = self._exist(state[new], token[new])
            self.decided[slot[new]] = arc[new] << 1 | there[new]
        return there

    def _spell(self, spelling: dict[int, tuple[int, ...]]) -> None:
        """The table that reads symbols: transitions of a trie of the spellings, failures filled in."""
        children: list[dict[int, int]] = [{}]
        token_at, size_at = [-1], [0]
        used = {s for symbols in spelling.values() if len(symbols) > 1 for s in symbols}
        # symbols of no merge share column 0: they lead to their own node from everywhere
        self.column = np.zeros(512, np.int64)
        self.column[sorted(used)] = np.arange(1, len(used) + 1)
        for token, symbols in spelling.items():
            at = 0
            for s in symbols:
                to = children[at].get(s)
                if to is None:
                    to = children[at][s] = len(children)
                    children.append({})
                    token_at.append(-1)
                    size_at.append(0)
                at = to
            token_at[at], size_at[at] = token, len(symbols)
        self.alone = np.zeros(512, np.int64)
        for s, to in children[0].items():
            self.alone[s] = to
        column, n = self.column.tolist(), len(children)
        self.table = np.zeros((n, len(used) + 1), np.int32)
        fail, shorter, level = [0] * n, [0] * n, [0]
        while level:
            below = []
            for at in level:
                row = self.table[at]
                if at:
                    row[:] = self.table[fail[at]]
                    f = fail[at]
                    shorter[at] = f if token_at[f] >= 0 else shorter[f]
                for s, to in children[at].items():
                    c = column[s]
                    fail[to] = int(row[c]) if at and c else 0
                    if c:
                        row[c] = to
                    below.append(to)
            level = below
        # the tokens that end at a node: its own or the next shorter one's node, and so on
        self.token_at, self.size_at = np.array(token_at, np.int64), np.array(size_at, np.int64)
        self.shorter = np.array(shorter, np.int64)
        self.longest = np.where(self.token_at >= 0, np.arange(n), self.shorter)

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one non-empty pre-split word."""
        return self.encode_all([word])[0].tolist()

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (none of them empty), one after another, and where each word's ids begin and end."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        apart = int((size > LONG_WORD).sum())
        parts = [self._read_long(words[i]) for i in order[:apart].tolist()]
        counts = [np.array([len(x)]) for x in parts]
        for a in range(apart, len(words), WORDS_AT_ONCE):
            some = order[a:a + WORDS_AT_ONCE]
            ids, n = self._read(b"".join([words[i] for i in some.tolist()]), size[some])
            parts.append(ids)
            counts.append(n)
        if not parts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        flat, count = np.concatenate(parts), np.concatenate(counts)
        begin = np.cumsum(count) - count
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return ragged(flat, begin[back], count[back])

    def _read(self, data: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie one after another in `data`, longest first, and their numbers."""
        symbols = np.frombuffer(data, np.uint8).astype(np.int64)
        begin = np.cumsum(size) - size
        words, most = len(size), int(size[0])
        last = np.full((most + 1, words), -1, np.int64)      # last token of each prefix's encoding
        came = np.zeros((most + 1, words), np.int64)         # and where that token begins
        at = np.zeros(words, np.int64)
        for n in range(1, most + 1):
            k = int(np.searchsorted(-size, -n, "right"))     # words with an n-th symbol
            symbol = symbols[begin[:k] + n - 1] + 256 * (size[:k] == n)
            column = self.column[symbol]
            to = self.table[at[:k], column].astype(np.int64)
            at = np.where(column == 0, self.alone[symbol], to)
            word, node = np.arange(k), self.longest[at]
            while len(word):
                token, start = self.token_at[node], n - self.size_at[node]
                before = last[start, word]
                ok = before < 0
                ask = np.flatnonzero(~ok)
                ok[ask] = self.arcs(before[ask], token[ask])
                done = word[ok]
                last[n, done], came[n, done] = token[ok], start[ok]
                word, node = word[~ok], self.shorter[node[~ok]]
        count, left, word = np.zeros(words, np.int64), size.copy(), np.arange(words)
        found = []
        while len(word):                                     # from the last token to the first
            found.append((word, last[left[word], word]))
            count[word] += 1
            left[word] = came[left[word], word]
            word = word[left[word] > 0]
        ids, end = np.empty(int(count.sum()), np.int32), np.cumsum(count)
        for n, (word, token) in enumerate(found, 1):
            ids[end[word] - n] = token
        return ids, count

    def _read_long(self, word: bytes) -> np.ndarray:
        """Ids of one word that is read alone, symbol by symbol."""
        last, came, at = [-1], [0], 0
        symbols = [*word[:-1], 256 + word[-1]]
        column, alone = self.column.tolist(), self.alone.tolist()
        known: dict[tuple[int, int], bool] = {}
        tokens: dict[int, list[tuple[int, int]]] = {}        # tokens that end at a node, longest first
        for n, symbol in enumerate(symbols, 1):
            c = column[symbol]
            at = self.table.item(at, c) if c else alone[symbol]
            if at not in tokens:
                tokens[at], node = [], self.longest.item(at)
                while node:
                    tokens[at].append((self.token_at.item(node), self.size_at.item(node)))
                    node = self.shorter.item(node)
            for token, size in tokens[at]:
                before = last[n - size]
                if before < 0:
                    break
                if (before, token) not in known:
                    if len(known) >= LONG_ARCS:
                        known.clear()
                    known[before, token] = self.has_arc(before, token, 1 << 30)
                if known[before, token]:
                    break
            last.append(token)
            came.append(n - size)
        ids, n = [], len(word)
        while n:
            ids.append(last[n])
            n = came[n]
        return np.array(ids[::-1], np.int32)


def ragged(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `flat` one after another, and where each begins and the last one ends."""
    edge = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=edge[1:])
    return flat[np.arange(edge[-1]) + np.repeat(begin - edge[:-1], count)], edge


class TextCodec:
    """Encodes and decodes whole texts as the tokenizer file says."""

    def __init__(self, spec: str):
        import regex

        t = json.loads(spec)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in t["model"]["merges"]]
        self.automaton = Automaton(merges, t["model"]["vocab"])
        self.special = {a["content"]: a["id"] for a in t["added_tokens"]}
        self.labels = self.automaton.label | {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # fixed value: the pre-split pattern of the tokenizer file, white space spelt out; a line end ends a chunk
        self.pattern = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks (no line ends in them), one after another, and where each chunk's ids begin and the
        last ones end.  The chunks are split as lines of one text; special tokens are lines of their own."""
        lines, last, special = chunks, np.arange(len(chunks)), {}
        if self.cut and any("<|" in c for c in chunks):
            lines, last = [], []
            for chunk in chunks:
                for part in self.cut.split(chunk) if "<|" in chunk else (chunk,):
                    if part in self.special:
                        special[len(lines)] = self.special[part]
                        part = ""
                    lines.append(part)
                last.append(len(lines) - 1)
        text = "".join([line + "\n" for line in lines])
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        found = self.pattern.findall(text)
        place = dict.fromkeys(found)
        place.pop("\n", None)
        ids, edge = self.automaton.encode_all([w.encode("utf-8") for w in place])
        place = dict(zip(place, range(len(place))))
        place["\n"] = len(place)                  # a line end has no ids
        which = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
        ends = np.flatnonzero(which == place["\n"])
        fixed = sorted(set(special.values()))     # but that of a special token has its id
        for line, i in special.items():
            which[ends[line]] = len(place) + fixed.index(i)
        flat = np.concatenate([ids, np.array(fixed, np.int32)])
        begin = np.concatenate([edge, len(ids) + np.arange(len(fixed))])
        count = np.concatenate([np.diff(edge), [0], np.ones(len(fixed), np.int64)])
        out, at = ragged(flat, begin[which], count[which])
        edges = np.zeros(len(chunks) + 1, np.int64)
        edges[1:] = at[ends[last] + 1]
        return out, edges

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids begin and the last ones end."""
        chunks = list(map(self.chunks, texts))
        place = dict.fromkeys(chain.from_iterable(chunks))
        ids, edge = self.encode_chunks(list(place))
        place = dict(zip(place, range(len(place))))
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        which = np.fromiter(map(place.__getitem__, chain.from_iterable(chunks)), np.int64, int(size.sum()))
        out, at = ragged(ids, edge[which], np.diff(edge)[which])
        return out, at[np.concatenate([[0], np.cumsum(size)])]

    def chunks(self, text: str) -> list[str]:
        """White-space separated chunks; encoding works on each alone.

        `str.split` also splits at the separators 0x1c-0x1f, which the tokenizer takes for symbols.
        """
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [c for c in re.split("[ \t\n\r]+", text) if c]
        return text.split()

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts([text or ""])[0].tolist()

    def decode(self, ids) -> str:
        return " ".join([self.labels[i] for i in ids])


def slices(texts: pa.Array, most_chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive texts (null: empty) with about `most_chars` characters together, at least one text."""
    some, chars = [], 0
    for text in texts:
        some.append(text.as_py() or "")
        chars += len(some[-1])
        if chars >= most_chars:
            yield some
            some, chars = [], 0
    if some:
        yield some


def codec(spec: str) -> TextCodec:
    """The worker's codec; built once per process and kept until another operator's step begins."""
    have = held.get("codec")
    if have is None or have[0] != spec:
        have = held["codec"] = (spec, TextCodec(spec))
    return have[1]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; a null text has no ids."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        c = codec(spec.value)
        for b in batches:
            at = 0
            for texts in slices(b.column(1)):
                ids, edges = c.encode_texts(texts)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), lists], ["doc_id", "ids"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """`encoded` with the column `decoded`: the arc labels of the ids, joined by one space."""
    from pyspark.sql.functions import pandas_udf

    spec = encoded.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    @pandas_udf("string")
    def labels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enter("bpe")
        c = codec(spec.value)
        for ids in batches:
            yield ids.map(lambda x: "" if x is None else c.decode(x))

    return encoded.withColumn("decoded", labels(ids_col))


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without shipping the ids back to the JVM.

    A null or empty text has no tokens; a null id stays null; rows that repeat an id are encoded one by one; an
    empty table gives no rows; other columns are not read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        c = codec(spec.value)
        decimal = {i: str(i) for i in c.labels}
        for b in batches:
            n, one, two = [], [], []
            for texts in slices(b.column(1)):
                ids, edges = c.encode_texts(texts)
                for a, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    some = ids[a:e].tolist()
                    n.append(e - a)
                    one.append(hashlib.sha256(" ".join(map(decimal.__getitem__, some)).encode()).hexdigest())
                    two.append(hashlib.sha256(c.decode(some).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(read_table(spark, sf_dir, "documents"))
