"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

BPE by merge rank has one property that makes prefixes shareable: a sequence of tokens is the
encoding of its bytes exactly if every two neighbours are the encoding of theirs. So the encoding
of a prefix is fixed by its last token and the encoding of what stands before it, and exactly one
token that ends a prefix fits what stands before. The distinct words of a block are inserted into
a trie whose edges hold the bytes up to the next branch; a depth-first traversal hands each prefix
the last-token states of those before it and finds its own, so a prefix that many words share is
encoded once. A word's ids are read back by following last tokens from its end.

Words and their ids stay in a bounded table of two generations for each worker: when the younger is
full, the older goes, and words that are met again come over. No row is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelace.llm.common import blocks, owned, read_tables, ship, task, utf8

#: Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters, and no other kinds of characters, beyond ASCII: texts of these and ASCII are split by a plainer form of PATTERN.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NOT_LATIN = re.compile(f"[^\x00-\x7f{LATIN}]").search


def _narrow(letters: str) -> str:
    """PATTERN for texts whose only letters are these and whose only digits and spaces are ASCII's."""
    return PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}0-9]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", "[0-9]")


#: Distinct words in a generation of a worker's table, of which there are two.
MAX_WORDS = 200_000
#: Pairs of tokens, in a generation, whose fit a worker keeps; and transitions of the automaton beside its own.
MAX_PAIRS = 300_000
#: Bytes of the words of a generation at most, so that very long words don't stay.
MAX_WORD_BYTES = 8 << 20


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + n)
    return out


class Tokenizer:
    """A byte-level BPE vocabulary from a tokenizers JSON file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        back = {c: b for b, c in byte_chars().items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in model["vocab"].items()}
        ids = {s: i for s, i in model["vocab"].items()}
        self.byte_id = [ids[c] for _, c in sorted(byte_chars().items())]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split_words = regex.compile(PATTERN)
        self.split_plain = re.compile(_narrow("A-Za-z"), re.ASCII)
        self.split_latin = re.compile(_narrow("A-Za-z" + LATIN), re.ASCII)
        # how a token is made: its merge's rank and halves; bytes have rank -1
        self.made: dict[int, tuple[int, int, int]] = {i: (-1, i, i) for i in self.byte_id}
        for (a, b), (rank, i) in self.merge.items():
            self.made.setdefault(i, (rank, a, b))
        self.rank_of = {pair: rank for pair, (rank, _) in self.merge.items()}
        # only tokens that encode to themselves can stand in an encoding
        own: dict[int, bool] = {}
        for i, (rank, a, b) in sorted(self.made.items(), key=lambda x: x[1][0]):
            own[i] = rank < 0 or own.get(a, False) and own.get(b, False) and self._apart(a, b, rank)
        self._automaton([i for i, ok in own.items() if ok])
        self.wide = 1 + max(self.bytes_of)
        #: first token * wide + second token -> whether the second can follow the first
        self.fits: dict[int, bool] = {}
        self.old_fits: dict[int, bool] = {}
        self.ids: dict[str, bytes] = {}
        self.old_ids: dict[str, bytes] = {}
        self.kept_bytes = 0
        size = np.zeros(self.wide, np.int64)
        for i, raw_bytes in self.bytes_of.items():
            size[i] = len(raw_bytes)
        self.token_size, self.token_at = size, np.cumsum(size) - size
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(self.wide)), np.uint8)

    def _automaton(self, tokens: list[int]) -> None:
        """Aho-Corasick over the tokens: ends[s] has (token, bytes) of all that end in state s, longest first."""
        self.go: list[dict[int, int]] = [{}]
        self.fail = [0]
        own: list[tuple[int, int] | None] = [None]
        for t in tokens:
            s = 0
            for c in self.bytes_of[t]:
                n = self.go[s].get(c)
                if n is None:
                    n = self.go[s][c] = len(self.go)
                    self.go.append({})
                    self.fail.append(0)
                    own.append(None)
                s = n
            own[s] = (t, len(self.bytes_of[t]))
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.go)
        self.spare = 0  # the trie must be whole before transitions are kept in it
        level = [0]
        while level:
            deeper = []
            for s in level:
                f = self.fail[s]
                self.ends[s] = ((own[s],) if own[s] else ()) + (self.ends[f] if s else ())
                for c, n in self.go[s].items():
                    self.fail[n] = self.step(f, c) if s else 0
                    deeper.append(n)
            level = deeper
        self.spare = MAX_PAIRS

    def step(self, s: int, c: int) -> int:
        """The state after s by byte c; transitions that fall back are kept beside the trie's own."""
        go, fail, at = self.go, self.fail, s
        while (n := go[at].get(c)) is None:
            if not at:
                n = 0
                break
            at = fail[at]
        if self.spare > 0:
            self.spare -= 1
            go[s][c] = n
        return n

    def merged(self, word: bytes, ids: list[int] | None = None) -> list[int]:
        """Encoding by merging the pair of least rank, leftmost first: short sequences only."""
        ids = [self.byte_id[b] for b in word] if ids is None else ids
        while len(ids) > 1:
            best = min((self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge) if any(p in self.merge for p in zip(ids, ids[1:])) else None
            if best is None:
                break
            pair = (ids[best[1]], ids[best[1] + 1])
            new, out, k = self.merge[pair][1], [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _apart(self, a: int, b: int, bound: float) -> bool:
        """Whether no merge of a rank below bound crosses the border of a and b.

        The merges at the border are undone, latest first; before a's last merge its right half
        stood there, before b's its left half. Merges of one rank run from left to right, so a
        crossing pair of b's own rank comes first, and one of a's comes too late.
        """
        made, rank_of = self.made, self.rank_of
        while True:
            if rank_of.get((a, b), bound) < bound:
                return False
            ra, rb = made[a][0], made[b][0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, a = ra, made[a][2]
            else:
                bound, b = rb + 1, made[b][1]

    def fit(self, key: int) -> bool:
        """Whether the second token of a packed pair can follow the first."""
        got = self.old_fits.get(key)
        if got is None:
            got = self._apart(*divmod(key, self.wide), float("inf"))
        if len(self.fits) >= MAX_PAIRS:
            self.old_fits, self.fits = self.fits, {}
        self.fits[key] = got
        return got

    def _read(self, state, depth: int) -> list[int]:
        out, size, wide = [], self.bytes_of, self.wide
        while depth:
            t = state[depth] // wide
            out.append(t)
            depth -= len(size[t])
        return out[::-1]

    def trie(self, words: list[str]) -> dict:
        """A trie of the words' bytes: node[first byte] = (bytes of the edge, node); node[-1] is the word that ends there."""
        root: dict = {}
        for w in words:
            raw = w.encode()
            node, at, n = root, 0, len(raw)
            while at < n:
                c = raw[at]
                edge = node.get(c)
                if edge is None:
                    node[c] = (raw[at:], {-1: w})
                    break
                label, child = edge
                if raw.startswith(label, at):
                    node, at = child, at + len(label)
                    continue
                k, most = 1, min(len(label), n - at)
                while k < most and label[k] == raw[at + k]:
                    k += 1
                fork = {label[k]: (label[k:], child)}
                node[c] = (label[:k], fork)
                node, at = fork, at + k
            else:
                node[-1] = w
        return root

    def learn(self, words: list[str]) -> None:
        """Encode distinct words by a trie and put them into the table.

        state[d] is the last token of the encoding of the first d bytes on the way to a node, times
        wide. Of the tokens that end there, longest first, exactly one fits what stands before it.
        """
        longest = 1 + max(map(len, map(str.encode, words)))
        state = [0] * longest if longest < 1 << 16 else array("q", bytes(8 * longest))
        stack: list[tuple[int, int, bytes, dict]] = [(0, 0, b"", self.trie(words))]
        go, step, ends, keep, read, wide = self.go, self.step, self.ends, self._keep, self._read, self.wide
        slow = self.fit
        while stack:
            depth, s, label, node = stack.pop()
            fits = self.fits
            for c in label:
                n = go[s].get(c)
                s = step(s, c) if n is None else n
                depth += 1
                for t, size in ends[s]:
                    if size == depth:
                        break
                    key = state[depth - size] + t
                    f = fits.get(key)
                    if f or f is None and slow(key):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                state[depth] = t * wide
            for k, child in node.items():
                if k >= 0:
                    stack.append((depth, s, *child))
            if (word := node.get(-1)) is not None:
                keep(word, read(state, depth))

    def _keep(self, word: str, ids: list[int]) -> None:
        self.ids[word] = got = array("I", ids).tobytes()
        self.kept_bytes += len(got)

    def split(self, text: str) -> list[str]:
        return (self.split_plain if text.isascii() else self.split_latin if NOT_LATIN(text) is None else self.split_words).findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        for k, part in enumerate(self.split_special.split(text)):
            out += [part] if k % 2 else self.split(part)
        return out

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """The ids, as little-endian uint32, of each text."""
        if len(self.ids) > MAX_WORDS or self.kept_bytes > MAX_WORD_BYTES:
            self.old_ids, self.ids, self.kept_bytes = self.ids, {}, 0
        for s, i in self.special.items():
            self._keep(s, [i])
        split = [self.pieces(t) for t in texts]
        if new := set().union(*split).difference(self.ids):
            old = self.old_ids
            known = new.intersection(old)
            self.ids.update((w, old[w]) for w in known)
            if fresh := list(new - known):
                self.learn(fresh)
        ids = self.ids.__getitem__
        return [b"".join(map(ids, words)) for words in split]

    def decode_block(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each sequence of ids, as little-endian uint32, stands for."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        out, sizes = [], [np.zeros(1, np.int64)]
        for k in range(0, len(flat), 1 << 17):
            part = flat[k : k + (1 << 17)].astype(np.int64)
            size = self.token_size[part]
            upto = np.cumsum(size)
            out.append(self.token_bytes[np.repeat(self.token_at[part] - upto + size, size) + np.arange(upto[-1])].tobytes())
            sizes.append(size)
        raw, upto = b"".join(out), np.concatenate(sizes).cumsum()
        cut = upto[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_block([text])[0], "<u4").tolist()

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Tokenizer] = {}
owned(_loaded.clear)


def _worker(packed) -> Tokenizer:
    """The worker's tokenizer; it is kept between tasks of a job."""
    if packed.id not in _loaded:
        _loaded.clear()
        _loaded[packed.id] = Tokenizer(json.loads(packed.value))
    return _loaded[packed.id]


class _Packed:
    """A vocabulary on its way to the executors: a broadcast, whose size is the vocabulary's and not the data's."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.id = hashlib.sha256(text.encode()).hexdigest()
        self._b = spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self._b.value


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row, in full; a null text is empty. vocabulary: a tokenizers JSON file."""
    return _run(docs, vocabulary, id_col, text_col, digests=False)


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encodes every row, decodes its ids, and digests both.

    Null texts are empty; repeated rows stay repeated; an empty table gives no rows; texts of any
    length are whole; other columns are ignored.
    """
    return _run(docs, vocabulary, id_col, text_col, digests=True)


def _run(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    packed = _Packed(spark, vocabulary)
    src = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    kind = src.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")

    def run(batches):
        tok = _worker(packed)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            raw, off = utf8(batch.column(1))
            data = raw.tobytes()
            for lo, hi in blocks(np.diff(off)):
                got = tok.encode_block([data[off[i] : off[i + 1]].decode("utf-8", "replace") for i in range(lo, hi)])
                ids = batch.column(0).slice(lo, hi - lo)
                if digests:
                    n = pa.array([len(x) // 4 for x in got], pa.int64())
                    cols = [ids, n, pa.array([sha(x) for x in got]), pa.array([sha(y.decode("utf-8", "replace").encode()) for y in tok.decode_block(got)])]
                    yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ends = np.cumsum([0, *(len(x) // 4 for x in got)]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32))
                    yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), values)], names=[id_col, "ids"])

    return src.mapInArrow(task("bpe", run), schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    return encode_digests(docs, default_vocabulary())
