"""Token ids of whole texts by a public byte-level BPE vocabulary, contracted in DuckDB by recursive queries.

Inside a Spark task texts are split by the vocabulary's pattern; words not met before in the worker become rows
(word, position, token), one for each byte, and a recursive query joins neighbouring rows with the merge table and
contracts each word's leftmost pair of minimum rank until none is left. An ordered aggregation then reads each word's
ids off its last step, and texts are put together from their words' ids. Long words are first cut where no token of the
vocabulary covers the cut, which changes no result and keeps the recursion short.

The recursion holds every step of a word, so its rows grow with the square of the word. What is still longer than
``PART`` bytes is therefore contracted in parts and the seams are mended: a row of tokens is the encoding of its bytes
just if each two neighbours are the encoding of theirs (which holds where every merge comes after those that make its
two sides; checked when a vocabulary is loaded). Where the two tokens beside a seam are not, more and more tokens around
it are contracted anew. So a word of any length, as separator lines or runs of one letter, costs in proportion to it.

Results for odd input: null and empty texts give an empty list; blank texts are encoded as they are; special tokens'
strings are ordinary text; lone surrogates can't occur in Spark strings; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import bisect
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from convolens.llm.batches import slices
from convolens.session import table

#: Where the public tokenizers' files are; the same on all machines.
FOLDER = os.environ.get("CONVOLENS_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that comes with these vocabularies and splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept by a worker between batches and their ids, bytes contracted by one recursive query, characters split at a time.
KEPT_WORDS, KEPT_IDS, QUERY_BYTES, BLOCK = 300_000, 8_000_000, 200_000, 2_000_000
#: Words of more bytes are cut before the recursion; pieces of more bytes than PART are contracted in parts.
LONG, PART = 16, 64
#: Rows that one recursive query may come to hold, about; small pieces kept by a worker; tokens first taken beside a seam; seams mended at a time.
QUERY_ROWS, KEPT_PIECES, BESIDE, SEAMS = 4_000_000, 200_000, 8, 4096

_CONTRACT = """
WITH RECURSIVE state(word, pos, tok, step) AS (
  SELECT word, pos, tok, 0 FROM start
  UNION ALL
  (WITH pair AS (
     SELECT word, pos, tok, step, lead(pos) OVER w AS next_pos, lead(tok) OVER w AS next_tok
     FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)),
   best AS (
     SELECT pair.word, min(merges.rank * 1048576 + pair.pos) AS k, arg_min(pair.next_pos, merges.rank * 1048576 + pair.pos) AS gone,
            arg_min(merges.id, merges.rank * 1048576 + pair.pos) AS id
     FROM pair JOIN merges ON pair.tok = merges.l AND pair.next_tok = merges.r GROUP BY pair.word)
   SELECT pair.word, pair.pos, CASE WHEN pair.pos = best.k % 1048576 THEN best.id ELSE pair.tok END, pair.step + 1
   FROM pair JOIN best ON pair.word = best.word WHERE pair.pos <> best.gone)),
last AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT state.word, list(state.tok ORDER BY state.pos) AS ids FROM state JOIN last ON state.word = last.word AND state.step = last.step
GROUP BY state.word ORDER BY state.word
"""


def _byte_chars() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """One vocabulary in one worker: its DuckDB with the merge table, and the words met so far."""

    def __init__(self, folder: str, name: str):
        import ahocorasick
        import duckdb

        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        chars = _byte_chars()
        back = {c: b for b, c in chars.items()}
        vocab = model["vocab"]
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        born = {a + b: i for i, (a, b) in reversed(list(enumerate(pairs)))}
        if any(born.get(x, -1) >= i for i, p in enumerate(pairs) for x in p):
            raise ValueError(f"{name}: a merge comes before one that makes its side")
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        merges = pa.table({"l": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "r": pa.array([vocab[b] for _, b in pairs], pa.int32()), "id": pa.array([vocab[a + b] for a, b in pairs], pa.int32()), "rank": pa.array(range(len(pairs)), pa.int64())})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.db.unregister("merges_in")
        self.tokens = ahocorasick.Automaton()
        for t in vocab:
            if len(t) > 1 and all(c in back for c in t):
                self.tokens.add_word("".join(chr(back[c]) for c in t), len(t))
        self.tokens.make_automaton()
        self.split = regex.compile(PATTERN).findall
        # the words met so far: each has a number, and its ids lie in the store from its head on
        self.words: dict[str, int] = {}
        self.heads, self.sizes, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pieces: dict[bytes, list[int]] = {}

    def cut(self, word: bytes) -> list[bytes]:
        """The word in pieces: between two of them lies no token of the vocabulary, so no merge can cross."""
        if len(word) <= LONG:
            return [word]
        covered = np.zeros(len(word) + 1, np.int32)
        for end, n in self.tokens.iter(word.decode("latin-1")):
            covered[end - n + 2] += 1  # boundaries strictly inside the token
            covered[end + 1] -= 1
        cuts = [0, *(np.flatnonzero(np.cumsum(covered[:-1])[1:] == 0) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, by recursive queries over bounded lots of pieces."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(pieces):
            end, size, rows = at, 0, 0
            while end < len(pieces):
                size += len(pieces[end])
                rows += len(pieces[end]) * (len(pieces[end]) + 1) // 2
                if end > at and (size > QUERY_BYTES or rows > QUERY_ROWS):
                    break
                end += 1
            lot = pieces[at:end]
            lengths = np.array([len(p) for p in lot])
            heads = np.r_[0, np.cumsum(lengths)]
            start = pa.table({"word": np.repeat(np.arange(len(lot), dtype=np.int32), lengths), "pos": (np.arange(heads[-1]) - np.repeat(heads[:-1], lengths)).astype(np.int32), "tok": self.first[np.frombuffer(b"".join(lot), np.uint8)]})
            self.db.register("start", start)
            ids = self.db.sql(_CONTRACT).to_arrow_table()["ids"].combine_chunks()
            self.db.unregister("start")
            if isinstance(ids, pa.ChunkedArray):
                ids = ids.combine_chunks()
            flat, off = ids.values.to_numpy(zero_copy_only=False).astype(np.int32), ids.offsets.to_numpy()
            out += [flat[a:b] for a, b in zip(off.tolist(), off[1:].tolist())]
            at = end
        return out

    def _contracted(self, pieces: list[bytes]) -> None:
        """Puts the ids of small pieces among those kept."""
        if len(self.pieces) > KEPT_PIECES:
            self.pieces = {}
        new = list({p: None for p in pieces if p not in self.pieces})
        for p, ids in zip(new, self.contract(new)):
            self.pieces[p] = ids.tolist()

    def _kept(self, piece: bytes) -> list[int]:
        if piece not in self.pieces:
            self._contracted([piece])
        return self.pieces[piece]

    def _ids(self, tokens: list[int]) -> list[int]:
        """The ids that the tokens' bytes have."""
        return self._kept(b"".join(map(self.bytes_of.__getitem__, tokens)))

    def _fits(self, a: int, b: int) -> bool:
        return self._ids([a, b]) == [a, b]

    def _foresee(self, seams: list[tuple[list[int], list[int]]]) -> None:
        """Contracts what the seams between parts will ask for if none changes its neighbours', in a few queries for all."""
        spell = lambda tokens: b"".join(map(self.bytes_of.__getitem__, tokens))
        self._contracted([spell([a[-1], b[0]]) for a, b in seams])
        open_ = [(a, b, BESIDE, BESIDE) for a, b in seams if not self._fits(a[-1], b[0])]
        while open_:
            self._contracted([spell(a[-i:] + b[:j]) for a, b, i, j in open_])
            mids = [self._ids(a[-i:] + b[:j]) for a, b, i, j in open_]
            ends = [([a[-i - 1], m[0]] if i < len(a) else None, [m[-1], b[j]] if j < len(b) else None) for (a, b, i, j), m in zip(open_, mids)]
            self._contracted([spell(x) for pair in ends for x in pair if x])
            ok = [[x is None or self._fits(*x) for x in pair] for pair in ends]
            open_ = [(a, b, i if low else 2 * i, j if high else 2 * j) for (a, b, i, j), (low, high) in zip(open_, ok) if not (low and high)]

    def in_parts(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of long pieces, contracted in parts whose seams are mended from left to right."""
        out = []
        a = 0
        while a < len(pieces):
            b, size = a, 0
            while b < len(pieces) and (b == a or size + len(pieces[b]) <= QUERY_BYTES):
                size += len(pieces[b])
                b += 1
            cuts = [[p[i : i + PART] for i in range(0, len(p), PART)] for p in pieces[a:b]]
            # what the parts of several pieces ask for is contracted together; a very long piece is a lot of its own
            for i in range(0, max(map(len, cuts)), SEAMS):
                self._contracted([x for c in cuts for x in c[i : i + SEAMS + 1]])
                lots = [[self._kept(x) for x in c[i : i + SEAMS + 1]] for c in cuts]
                self._foresee([seam for lot in lots for seam in zip(lot, lot[1:])])
                if i == 0:
                    made = [list(lot[0]) for lot in lots]
                for row, lot in zip(made, lots):
                    for part in lot[1:]:
                        self._mend(row, part)
            out += [np.array(x, np.int32) for x in made]
            a = b
        return out

    def _mend(self, out: list[int], part: list[int]) -> None:
        """Puts a part's ids after those before it, contracting anew what the seam between them changes."""
        if self._fits(out[-1], part[0]):
            out += part
            return
        left = right = BESIDE
        while True:
            mid = self._ids(out[-left:] + part[:right])
            low = left >= len(out) or self._fits(out[-left - 1], mid[0])
            high = right >= len(part) or self._fits(mid[-1], part[right])
            if low and high:
                break
            left, right = left if low else 2 * left, right if high else 2 * right
        out[-left:] = mid + part[right:]

    def learn(self, words: set[str]) -> None:
        """Adds the ids of new words."""
        new = [w for w in words if w not in self.words]
        if not new:
            return
        parts = [self.cut(w.encode("utf-8", "surrogatepass")) for w in new]
        pieces = sorted({p: None for ps in parts for p in ps}, key=len)
        number = {p: i for i, p in enumerate(pieces)}
        short = bisect.bisect_right(pieces, PART, key=len)
        ids = self.contract(pieces[:short]) + self.in_parts(pieces[short:])
        self._keep(new, [ids[number[ps[0]]] if len(ps) == 1 else np.concatenate([ids[number[p]] for p in ps]) for ps in parts])

    def _keep(self, words: list[str], ids: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        heads = len(self.store) + np.cumsum(sizes) - sizes
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.heads, self.sizes = np.concatenate([self.heads, heads]), np.concatenate([self.sizes, sizes])
        self.store = np.concatenate([self.store, *ids])

    def _make_room(self, known: set[str]) -> None:
        """Before known words are learnt: forgets the others if too many are kept."""
        if len(self.words) + len(known) <= KEPT_WORDS and len(self.store) <= KEPT_IDS:
            return
        kept = [w for w in known if w in self.words]
        ids = [self.store[self.heads[i] : self.heads[i] + self.sizes[i]] for i in map(self.words.__getitem__, kept)]
        self.words, self.heads, self.sizes, self.store = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._keep(kept, ids)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and where each word's begin (and the end of all)."""
        known = set(words)
        self._make_room(known)
        self.learn(known)
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[numbers]
        ends = np.zeros(len(words) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        return self.store[np.arange(ends[-1]) + np.repeat(self.heads[numbers] - ends[:-1], sizes)], ends

    def encode_long(self, text: str, words: int = 300_000) -> np.ndarray:
        """The ids of one text of any length, a bounded number of words at a time."""
        out, lot = [], []
        for m in regex.finditer(PATTERN, text):
            lot.append(m[0])
            if len(lot) == words:
                out.append(self.encode_words(lot)[0])
                lot = []
        return np.concatenate([*out, self.encode_words(lot)[0]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text's begin (and the end of all)."""
        if len(texts) == 1 and len(texts[0]) > BLOCK:
            ids = self.encode_long(texts[0])
            return ids, np.array([0, len(ids)])
        words: list[str] = []
        heads = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                words += self.split(t)
            heads[i + 1] = len(words)
        ids, ends = self.encode_words(words)
        return ids, ends[heads]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str, name: str) -> Encoder:
    """The worker's encoder: it is made once and serves all tasks the worker runs."""
    key = (folder, name)
    if key not in _encoders:
        _encoders[key] = Encoder(folder, name)
    return _encoders[key]


def blocks(texts: list[str], most: int = BLOCK):
    """Ranges of texts of about ``most`` characters together; a longer text is a range of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _ids(folder: str, name: str):
    def run(batches):
        enc = encoder(folder, name)
        for batch in slices(batches):
            texts = ["" if t is None else t for t in batch["text"].to_pylist()]
            for a, b in blocks(texts):
                ids, offsets = enc.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids): the token ids of each text by vocabulary ``name``, without special tokens."""
    return docs.select("doc_id", "text").mapInArrow(_ids(folder, name), "doc_id bigint, ids array<int>")


def _lengths(folder: str, name: str):
    def run(batches):
        enc = encoder(folder, name)
        size = np.zeros(max(enc.bytes_of) + 1, np.int64)
        for i, b in enc.bytes_of.items():
            size[i] = len(b)
        for batch in batches:
            ids = batch["ids"].combine_chunks() if isinstance(batch["ids"], pa.ChunkedArray) else batch["ids"]
            ends = np.r_[0, np.cumsum(size[ids.flatten().to_numpy()])]
            counts = np.diff(np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False))], prepend=0)[1:]
            at = np.cumsum(np.r_[0, counts])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts.astype(np.int64)), pa.array(ends[at[1:]] - ends[at[:-1]])], ["doc_id", "n_ids", "n_bytes"])

    return run


def decoded_lengths(ids: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, n_ids, n_bytes) of (doc_id, ids): how many bytes the ids stand for, which are those of the text."""
    return ids.select("doc_id", "ids").mapInArrow(_lengths(folder, name), "doc_id bigint, n_ids bigint, n_bytes bigint")


def count_tokens(text: Column, name: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """The number of tokens of a text by a rank file of the same vocabulary (a compiled library; sizes only)."""

    @F.pandas_udf(T.IntegerType())
    def count(texts):
        enc = _tiktoken(folder, name)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int32")

    return count(text)


_rank_files: dict[tuple[str, str], object] = {}


def _tiktoken(folder: str, name: str):
    import tiktoken

    key = (folder, name)
    if key not in _rank_files:
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _rank_files[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _rank_files[key]


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes): the bytes that each document's ids stand for."""
    return decoded_lengths(p7_ids(spark, sf_dir)).select("doc_id", "n_bytes")
