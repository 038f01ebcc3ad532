"""Operator 10, packing token sequences by order-preserving dynamic programming.

The documents of a task follow each other in the order they are read. Cuts fall at document ends, at
sentence ends or, where neither is near, at any token; the programme minimises padding plus a penalty
for each cut inside a document. With g(a) = f(a) + a the best cut before b is the least g within 4096
tokens, which a monotone queue keeps, so each candidate costs constant time. Sequences are padded to
their capacity unless their length is a power of two. There is no shuffle: each task packs what it
scans, so only its last sequence can't be chosen freely, and that one is cut into powers of two.

Tokens are those of the tokenizer applied to the whole text. It never joins anything over ASCII white
space, so distinct pieces between such bounds are tokenized once for each run of texts and looked up.

Defined cases: null and empty texts are the end id alone; rows that repeat are packed as often as they
come; an empty table packs to nothing; a null doc_id is kept as null; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textvec as V

CAPACITY, END = 4096, 2
TEXT_BYTES = 1 << 20  # of text that is tokenized at once
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_LETTER
_END = "\x01"  # ends a letter run for the rank encoder; a text that has it isn't given to that


def letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of letters a-z, A-Z and of the two-byte letters from U+00C0 to U+00FF."""
    lead = np.zeros(len(raw), bool)
    if len(raw) > 1:
        lead[:-1] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    out = _LETTER[raw] | lead
    out[1:] |= lead[:-1]
    return out


def rank_encoder(path: str):
    """(encode letter runs to ranks, id of each rank, which ranks end a run), or None if the file is of another kind.

    A byte-level BPE with word ends over lower-cased text splits letter runs off before merging, so a
    run can be encoded by the ranks of its merges: bytes, then bytes that end a run, then merges in order.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges, suffix = model.get("vocab", {}), model.get("merges"), model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not suffix or model.get("dropout") or model.get("ignore_merges"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte-level alphabet shows as themselves
    other = [b for b in range(256) if b not in shown]
    alphabet = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}
    end = _END.encode()

    def of(token: str) -> bytes | None:
        body, tail = (token[: -len(suffix)], end) if token.endswith(suffix) else (token, b"")
        return bytes(alphabet[c] for c in body) + tail if all(c in alphabet for c in body) else None

    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + end: 256 + b for b in range(256) if b != 1}
    for k, m in enumerate(merges):
        left, right = m if isinstance(m, list) else m.split(" ")
        if (made := (of(left) or b"") + (of(right) or b"")) in ranks:
            return None  # two ways to one token: ranks alone wouldn't tell them apart
        ranks[made] = 512 + k
    ids = {of(t): i for t, i in vocab.items() if of(t)}
    id_of = np.zeros(512 + len(merges), np.uint32)
    ends = np.zeros(512 + len(merges), bool)
    for token, r in ranks.items():
        id_of[r] = ids.get(token, 0)
        ends[r] = r >= 256 and token.endswith(end)
    coder = tiktoken.Encoding("runs", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
    return coder.encode_ordinary, id_of, ends


_LOADED: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of whole texts; distinct pieces of a run of texts are tokenized once.

    Pieces are cut at white space and between a letter and an ASCII mark or digit, where the tokenizer
    never joins (an apostrophe stays with the letters after it). Letter runs go to the rank encoder, all
    else to the tokenizer itself, and all of it if the rank encoder can't stand for the file. If the
    tokenizer keeps white space, whole texts are its pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.drops_space = ids(" ab \n\tcd ") == ids("ab") + ids("cd")
        self.ranked = rank_encoder(path) if self.drops_space else None

    @staticmethod
    def load(path: str) -> WordTokenizer:
        """The worker's one tokenizer for the file."""
        if path not in _LOADED:
            _LOADED[path] = WordTokenizer(path)
        return _LOADED[path]

    def pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[V.Words, np.ndarray]:
        """(pieces, which of them are letter runs)"""
        if not self.drops_space:
            full = offsets[1:] > offsets[:-1]
            w = V.Words(raw, offsets[:-1][full], offsets[1:][full], np.concatenate([[0], np.cumsum(full)]))
            return w, np.zeros(len(w.start), bool)
        body = raw.tobytes()
        if self.ranked is None or _END.encode() in body or any(s in body for s in self.special):
            w = V.words(raw, offsets)
            return w, np.zeros(len(w.start), bool)
        letter = letters(raw)
        mark = _MARK[raw]
        cuts = np.zeros(len(raw), bool)
        cuts[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:] & (raw[:-1] != 39))
        w = V.words(raw, offsets, cuts)
        upto = np.concatenate([[0], np.cumsum(letter)])
        return w, upto[w.end] - upto[w.start] == w.end - w.start

    def tokens(self, words: list[str], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of distinct words."""
        count = np.zeros(len(words), np.int64)
        parts: list[np.ndarray] = []
        order: list[np.ndarray] = []
        easy, hard = np.flatnonzero(runs), np.flatnonzero(~runs)
        if len(easy):
            encode, id_of, ends = self.ranked
            got = np.array(encode(" ".join([words[i].lower() + _END for i in easy])), np.int64)
            count[easy] = np.diff(np.flatnonzero(ends[got]), prepend=-1)
            parts.append(id_of[got])
            order.append(easy)
        if len(hard):
            ids = [c.ids for c in self.tok.encode_batch_fast([words[i] for i in hard], add_special_tokens=False)]
            count[hard] = [len(i) for i in ids]
            parts.append(np.array([x for i in ids for x in i], np.uint32))
            order.append(hard)
        if not parts:
            return np.zeros(0, np.uint32), count
        flat, at = np.concatenate(parts), np.concatenate(order)
        begin = np.zeros(len(words), np.int64)
        begin[at] = np.concatenate([[0], np.cumsum(count[at])[:-1]])
        stop = np.cumsum(count)
        return flat[np.arange(stop[-1]) + np.repeat(begin - (stop - count), count)], count

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[V.Words, np.ndarray, np.ndarray]:
        """(pieces, all ids, end of each piece's ids)"""
        w, runs = self.pieces(raw, offsets)
        if not len(w.start):
            return w, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        coded = pa.array(V.word_hashes(w)).dictionary_encode()
        which = coded.indices.to_numpy()
        first = np.zeros(len(coded.dictionary), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        body = raw.tobytes()
        pool, count = self.tokens([body[s:e].decode("utf-8", "replace") for s, e in zip(w.start[first].tolist(), w.end[first].tolist())], runs[first])
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])[which]
        n = count[which]
        end = np.cumsum(n)
        return w, pool[np.arange(end[-1]) + np.repeat(begin - (end - n), n)], end


def candidates(total: int, ends: np.ndarray, sentences: np.ndarray, *, grid: int = 24, gap: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and their kinds: 0 a document end, 1 a sentence end (one per `grid` tokens), 2 any token."""
    sentences = sentences[(sentences > 0) & (sentences < total)]
    if len(sentences):
        last = np.append(sentences[1:] // grid != sentences[:-1] // grid, True)
        sentences = sentences[last]
    kind = {2: np.concatenate([[0], sentences, ends])}
    known = np.unique(kind[2])
    wide = np.flatnonzero(np.diff(known) > gap)
    hard = np.concatenate([np.arange(known[i] + gap, known[i + 1], gap) for i in wide]) if len(wide) else np.zeros(0, np.int64)
    at = np.unique(np.concatenate([known, hard])).astype(np.int64)
    kinds = np.full(len(at), 2)
    kinds[np.isin(at, sentences)] = 1
    kinds[np.isin(at, ends) | (at == 0)] = 0
    return at, kinds


def best_cuts(at: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY, open_cost: int = 16) -> list[int]:
    """Indices into `at` of the cheapest cuts from at[0] to at[-1]; gaps of `at` are at most `capacity`."""
    m = len(at)
    exact: dict[int, list[int]] = {}
    length = 1
    while length < capacity:
        j = np.searchsorted(at, at - length)
        ok = np.flatnonzero((at >= length) & (at[np.minimum(j, m - 1)] == at - length))
        for b in ok.tolist():
            exact.setdefault(b, []).append(int(j[b]))
        length *= 2
    pos, pen = at.tolist(), penalty.tolist()
    f, back = [0.0] * m, [0] * m
    queue: deque[int] = deque([0])
    for b in range(1, m):
        while pos[queue[0]] < pos[b] - capacity:
            queue.popleft()
        a = queue[0]
        cost, src = f[a] + capacity - (pos[b] - pos[a]), a
        for a in exact.get(b, ()):
            if f[a] < cost:
                cost, src = f[a], a
        f[b], back[b] = cost + pen[b] + open_cost, src
        key = f[b] + pos[b]
        while queue and f[queue[-1]] + pos[queue[-1]] >= key:
            queue.pop()
        queue.append(b)
    out = [m - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class Packer:
    """Packs the documents of one task as they come; what may still change is carried on."""

    def __init__(self, task: int, capacity: int, sentence: float, hard: float):
        self.next = task << 40
        self.capacity, self.penalty = capacity, np.array([0.0, sentence, hard])
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, tokens of it already packed, tokens of it here, all its tokens
        self.sentences: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_ids: list, ids: np.ndarray, ends: np.ndarray, sentences: np.ndarray) -> None:
        begin = 0
        for d, e in zip(doc_ids, ends.tolist()):
            self.docs.append((d, 0, e - begin, e - begin))
            begin = e
        self.ids.append(ids)
        self.sentences.append(sentences + self.size)
        self.size += len(ids)

    def pack(self, final: bool) -> list[tuple]:
        if not self.size:
            return []
        ids, sentences = np.concatenate(self.ids), np.concatenate(self.sentences)
        ends = np.cumsum([d[2] for d in self.docs])
        at, kinds = candidates(self.size, ends, sentences)
        cuts = at[best_cuts(at, self.penalty[kinds], self.capacity)].tolist()
        if final:
            rest = cuts[-1] - cuts[-2]
            bits = [1 << k for k in range(rest.bit_length())[::-1] if rest >> k & 1]
            if rest < self.capacity and (len(bits) - 1) * self.penalty[2] < self.capacity - rest:
                cuts[-1:] = (cuts[-2] + np.cumsum(bits)).tolist()
        elif len(cuts) > 2:
            cuts = cuts[:-1]
        out = []
        k, begin = 0, 0  # the document at hand and where it begins
        for s, e in zip(cuts[:-1], cuts[1:]):
            p = s
            while p < e:
                while begin + self.docs[k][2] <= p:
                    begin += self.docs[k][2]
                    k += 1
                d, gone, here, all_ = self.docs[k]
                q = min(e, begin + here)
                out.append((d, gone + p - begin, q - p, zlib.crc32(ids[p:q].tobytes()), all_, self.next, p - s))
                p = q
            self.next += 1
        last = cuts[-1]
        left = []
        begin = 0
        for d, gone, here, all_ in self.docs:
            if begin + here > last:
                used = max(0, last - begin)
                left.append((d, gone + used, here - used, all_))
            begin += here
        self.docs, self.ids, self.sentences, self.size = left, [ids[last:]], [sentences[sentences > last] - last], self.size - last
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END, sentence_penalty: float = 2.0, hard_penalty: float = 64.0, hold: int = 400_000) -> DataFrame:
    """Pieces of the sequences that hold docs (doc_id, text); tokenizer is the path of a tokenizer file.

    hold: tokens that are optimised together; the last sequence of each such run is carried on.
    """

    def run(batches):
        from pyspark import TaskContext

        tok = WordTokenizer.load(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), capacity, sentence_penalty, hard_penalty)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, raw, offsets in V.chunks(batch.column(1), TEXT_BYTES):
                w, got, word_end = tok.encode(raw, offsets)
                upto = np.concatenate([[0], word_end])[w.first]  # tokens before each text
                ends = upto[1:] + np.arange(1, b - a + 1)
                ids = np.empty(len(got) + b - a, np.uint32)
                shift = np.repeat(np.arange(b - a), np.diff(upto))
                ids[np.arange(len(got)) + shift] = got
                ids[ends - 1] = end_id
                last = np.flatnonzero(_STOP[raw[w.end - 1]]) if len(w.end) else np.zeros(0, np.int64)
                packer.add(doc_ids[a:b], ids, ends, word_end[last] + w.text[last])
                if packer.size >= hold:
                    if rows := packer.pack(False):
                        yield _batch(rows)
            V.release()
        if rows := packer.pack(True):
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
