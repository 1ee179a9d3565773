"""Operator 9, SentencePiece encoding and decoding: shared-prefix forward search over a trie of marked words.

White space is marked (U+2581) as the model does, and texts are cut into marked words. The distinct words of a batch
are sorted, so that neighbours share prefixes, and walked depth-first: the forward states of a common prefix are
computed once and reused by every word below it.

For a unigram model the forward state of a position is the best score of the text up to it and the piece that ends
there (Viterbi). The public model at hand is a BPE model, whose piece scores are merge ranks: Viterbi over them gives
other ids than the library (a piece of high rank is no better as part of a good path). Its forward state is therefore
the last piece of the BPE encoding of the text up to that position, which is unique: the one piece whose predecessor
state is compatible with it, that is, BPE leaves the two pieces apart. States depend on the prefix alone, as in
Viterbi, so the same walk gives exactly the library's ids.

Cases: null and empty texts have no ids and decode to an empty text; characters outside the vocabulary become their
bytes; runs of spaces and words of any length are encoded whole; repeated rows are encoded alike; extra columns pass
through `encoded` untouched unless they are named ids or decoded, which it replaces.
"""

from __future__ import annotations

import heapq
import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import bounded_batches, list_array, read_table, slices

MARK = "▁"
#: Words remembered by a worker between batches, at most; longer words than REMEMBERED_CHARS never are.
REMEMBERED_WORDS, REMEMBERED_CHARS = 220_000, 64
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: No piece ends here (a character outside the vocabulary stands alone).
NONE = -1


def pa_bool(mask: np.ndarray):
    import pyarrow as pa

    return pa.array(mask)


def gathered(begin: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the runs that begin at `begin`, one after the other; 32 bits are enough for the tables at hand."""
    out = np.repeat((begin - (ends - lengths)).astype(np.int32), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


def default_model() -> str:
    """Path of the public BPE model: QUARRYLINE_SPM_MODEL if set, else the installed tokenizer files."""
    path = os.environ.get("QUARRYLINE_SPM_MODEL")
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return str(path)


class Pieces:
    """Vocabulary of a model, with forward search for BPE and unigram models."""

    #: Words remembered, at most; REMEMBERED_WORDS if nothing else is asked.
    remembered: int | None = None

    def __init__(self, model_file: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.kind, self.names = kind, [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = {int(p[3:5], 16): i for i, p in enumerate(self.names) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.names[i]: i for i in normal}
        self.score = {self.names[i]: sp.get_score(i) for i in normal}
        self.unknown_score = min(self.score.values(), default=0.0) - 10
        #: pieces read from their last character backwards: {character: [id or NONE, {...}]}
        self.backward: dict = {}
        for name, i in self.id_of.items():
            node, at = self.backward, None
            for c in reversed(name):
                at = node.setdefault(c, [NONE, {}])
                node = at[1]
            at[0] = i
        self.shown = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.names)]
        self.shown_size = np.array([len(x) for x in self.shown], np.int64)
        self.shown_at = np.concatenate([[0], np.cumsum(self.shown_size)[:-1]])
        self.shown_bytes = np.frombuffer(b"".join(self.shown), np.uint8)
        if kind == "bpe":
            self._split_all()
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}  # of the words that are remembered
        self.flat, self.used, self.begin, self.size = np.zeros(1 << 16, np.int32), 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    # -- BPE --

    def merge(self, word: str, above: float | None = None) -> list[str]:
        """BPE by its definition: join the neighbours whose joint piece scores highest, leftmost first, until none is left (or none scores above `above`)."""
        part: list[str | None] = list(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        score = self.score
        heap = [(-s, i, 2) for i in range(len(word) - 1) if (s := score.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            worth, i, size = heapq.heappop(heap)
            if above is not None and -worth <= above:
                break
            left = part[i]
            j = after[i]
            if left is None or j >= len(word) or len(left) + len(part[j]) != size:  # type: ignore[arg-type]
                continue
            part[i], part[j] = left + part[j], None  # type: ignore[operator]
            after[i] = after[j]
            if after[i] < len(word):
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else len(word)
                if b < len(word) and (s := score.get(part[a] + part[b])) is not None:  # type: ignore[operator]
                    heapq.heappush(heap, (-s, a, len(part[a]) + len(part[b])))  # type: ignore[arg-type]
        return [p for p in part if p is not None]

    def _split_all(self) -> None:
        """For each piece: when it is made (0 for single characters), and the two pieces it is made of; pieces that no merge makes are never found."""
        by_rank = sorted((n for n in self.id_of if len(n) > 1), key=lambda n: -self.score[n])
        self.made = [0] * len(self.names)
        for rank, name in enumerate(by_rank, 1):
            self.made[self.id_of[name]] = rank
        self.left, self.right = [NONE] * len(self.names), [NONE] * len(self.names)
        self.joint: dict[int, int] = {}
        for name in by_rank:
            i = self.id_of[name]
            for k in range(1, len(name)):
                a, b = self.id_of.get(name[:k], NONE), self.id_of.get(name[k:], NONE)
                if a != NONE and b != NONE:
                    self.joint[a << 20 | b] = self.made[i]
        for name in by_rank:
            halves = self.merge(name, self.score[name])
            i = self.id_of[name]
            if len(halves) == 2 and all(h in self.id_of for h in halves):
                self.left[i], self.right[i] = (self.id_of[h] for h in halves)
            else:
                self._unlist(name)
        self.apart_known: dict[int, bool] = {}

    def _unlist(self, name: str) -> None:
        node, at = self.backward, None
        for c in reversed(name):
            at = node[c]
            node = at[1]
        at[0] = NONE

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves pieces a and b apart where they meet.

        Looks back in time: while a and b stand side by side, a merge across them must not come before the one that ends
        that state; then the piece made last is taken apart. A merge to the left goes first among equals.
        """
        key = a << 20 | b
        known = self.apart_known.get(key)
        if known is not None:
            return known
        made, joint, end, out = self.made, self.joint, 1 << 30, True
        while True:
            across = joint.get(a << 20 | b)
            if across is not None and across < end:
                out = False
                break
            x, y = made[a], made[b]
            if x > y:
                end, a = x, self.right[a]
            elif y:
                end, b = y + 1, self.left[b]
            else:
                break
        if len(self.apart_known) > (self.remembered or REMEMBERED_WORDS):
            self.apart_known = {}
        self.apart_known[key] = out
        return out

    # -- forward states: the piece that ends at each position (and its score, for unigram models) --

    def _walk_bpe(self, words: list[str]) -> list[list[int]]:
        root, names, apart, known = self.backward, self.names, self.apart, self.apart_known
        sizes = [len(n) for n in names] + [1]  # the last entry is that of NONE
        out, before, last = [], "", [NONE]
        for word in words:
            if word.startswith(MARK + MARK):  # equal scores of runs of marks are decided by place alone
                out.append(self._ids_of_pieces(self.merge(word)))
                continue
            n, top = 0, min(len(word), len(before))
            while n < top and word[n] == before[n]:
                n += 1
            del last[n + 1 :]
            for i in range(n, len(word)):
                node, j, found = root.get(word[i]), i, NONE
                while node is not None:
                    piece = node[0]
                    if piece >= 0:
                        left = last[j] if j else NONE
                        if left < 0 or ((ok := known.get(left << 20 | piece)) is None and apart(left, piece)) or ok:
                            found = piece
                    if not j:
                        break
                    j -= 1
                    node = node[1].get(word[j])
                last.append(found)
            ids, at = [], len(word)
            while at:
                piece = last[at]
                if piece < 0:
                    ids.extend(self.bytes_of[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass")))
                    at -= 1
                else:
                    ids.append(piece)
                    at -= sizes[piece]
            ids.reverse()
            out.append(ids)
            before = word
            known = self.apart_known
        return out

    def _walk_unigram(self, words: list[str]) -> list[list[int]]:
        root, score = self.backward, {i: self.score[n] for n, i in self.id_of.items()}
        out, before, last, best = [], "", [NONE], [0.0]
        for word in words:
            n, top = 0, min(len(word), len(before))
            while n < top and word[n] == before[n]:
                n += 1
            del last[n + 1 :], best[n + 1 :]
            for i in range(n, len(word)):
                node, j, found, high = root.get(word[i]), i, NONE, best[i] + self.unknown_score
                while node is not None:
                    if node[0] >= 0 and best[j] + score[node[0]] > high:
                        found, high = node[0], best[j] + score[node[0]]
                    if not j:
                        break
                    j -= 1
                    node = node[1].get(word[j])
                last.append(found)
                best.append(high)
            ids, at = [], len(word)
            while at:
                piece = last[at]
                ids.append(word[at - 1] if piece < 0 else piece)
                at -= 1 if piece < 0 else len(self.names[piece])
            out.append([x for p in reversed(ids) for x in ((p,) if isinstance(p, int) else (self.bytes_of[b] for b in p.encode("utf-8", "surrogatepass")))])
            before = word
        return out

    def walk(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words: sorted, then depth-first over their common prefixes."""
        words = sorted(words)
        return dict(zip(words, self._walk_bpe(words) if self.kind == "bpe" else self._walk_unigram(words), strict=True))

    def _ids_of_pieces(self, pieces: list[str]) -> list[int]:
        return [x for p in pieces for x in ((self.id_of[p],) if p in self.id_of else (self.bytes_of[b] for b in p.encode("utf-8", "surrogatepass")))]

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words; those that are new are encoded first."""
        fresh = [w for w in words if w not in self.number]
        if fresh:
            base = len(self.number)
            ids = self.walk(fresh)
            sizes = np.fromiter(map(len, ids.values()), np.int64, len(ids))
            need, total = base + len(ids), self.used + int(sizes.sum())
            if need > len(self.begin):
                self.begin, self.size = np.resize(self.begin, 2 * need), np.resize(self.size, 2 * need)
            if total > len(self.flat):
                self.flat = np.resize(self.flat, 2 * total)
            self.flat[self.used : total] = np.fromiter((x for v in ids.values() for x in v), np.int32, total - self.used)
            self.size[base:need] = sizes
            self.begin[base:need] = self.used + np.cumsum(sizes) - sizes
            self.used = total
            self.number.update(zip(ids, range(base, need), strict=True))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def encode_column(self, texts):
        """Flat ids and offsets of an Arrow string column. Only distinct words become Python strings, but for texts with
        runs of spaces, spaces at an end, or the mark itself."""
        import pyarrow.compute as pc

        if len(self.number) > (self.remembered or REMEMBERED_WORDS):
            self._forget()
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.match_substring(texts, MARK)))).to_numpy(zero_copy_only=False)
        plain = ~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        lists = pc.split_pattern(texts.filter(pa_bool(plain)), " ")
        coded = lists.flatten().dictionary_encode()
        numbers = self._numbers([MARK + w for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        counts = np.zeros(len(texts), np.int64)
        sizes = np.diff(lists.offsets.to_numpy())
        counts[plain] = sizes
        slow = {int(r): _WORD.findall(MARK + texts[int(r)].as_py().replace(" ", MARK)) for r in np.flatnonzero(odd)}
        for r, words in slow.items():
            counts[r] = len(words)
        starts = np.cumsum(counts) - counts
        every = np.empty(int(counts.sum()), np.int64)
        every[np.repeat(starts[plain] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(numbers))] = numbers
        for r, words in slow.items():
            own = sorted(set(words))
            look = dict(zip(own, self._numbers(own).tolist(), strict=True))
            every[starts[r] : starts[r] + len(words)] = [look[w] for w in words]
        lengths = self.size[every]
        ends = np.cumsum(lengths)
        flat = self.flat[gathered(self.begin[every], lengths, ends)]
        ends = np.concatenate([[0], ends])
        return flat, ends[np.append(starts, len(every))]

    def decode_column(self, flat: np.ndarray, offsets: np.ndarray):
        """Texts of flat ids as an Arrow column."""
        import pyarrow as pa

        size = self.shown_size[flat]
        ends = np.cumsum(size)
        data = self.shown_bytes[gathered(self.shown_at[flat], size, ends)]
        at = np.concatenate([[0], ends])[offsets]
        first = at[:-1][at[:-1] < at[1:]]
        first = first[data[first] == 32]  # the mark before each text
        keep = np.ones(len(data), bool)
        keep[first] = False
        at = at - np.searchsorted(first, at, "left")
        out = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data[keep].tobytes()))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that no encoder made
            return pa.array([self.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        import pyarrow as pa

        flat, offsets = self.encode_column(pa.array(texts, pa.string()))
        return np.split(flat, offsets[1:-1]) if texts else []

    def decode(self, ids) -> str:
        """The text of ids; the mark that encoding puts before a text is taken off."""
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[tuple[str, str], Pieces] = {}


def pieces_of(model_file: str, kind: str) -> Pieces:
    """The model, read once by each worker."""
    if (model_file, kind) not in _MODELS:
        _MODELS[model_file, kind] = Pieces(model_file, kind)
    return _MODELS[model_file, kind]


#: Characters (bytes) of texts encoded together, at most (one longer text goes alone).
BATCH_BYTES = 1_200_000


def encoded(docs: DataFrame, model_file: str | None = None, kind: str = "bpe", decode: bool = True, remembered: int | None = None) -> DataFrame:
    """`docs` with ids (array of int) and, with `decode`, decoded (the text of the ids); `remembered` bounds the words a worker keeps."""
    model_file = model_file or default_model()
    docs = bounded_batches(docs.drop("ids", "decoded"))
    at = docs.columns.index("text")

    def encode(batches):
        import pyarrow as pa

        pieces = pieces_of(model_file, kind)
        pieces.remembered = remembered
        for part in (part for b in batches for part in slices(b, at, BATCH_BYTES)):
            flat, offsets = pieces.encode_column(part.column(at))
            columns = [*part.columns, list_array(flat, offsets)]
            if decode:
                columns.append(pieces.decode_column(flat, offsets))
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "ids", *["decoded"] * decode])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(encode, f"{schema}, ids array<int>" + ", decoded string" * decode)


def decoded(rows: DataFrame, model_file: str | None = None, kind: str = "bpe", ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`rows` with the text of their ids."""
    model_file = model_file or default_model()

    @F.pandas_udf("string")
    def text(ids):
        p = pieces_of(model_file, kind)
        return ids.map(lambda x: None if x is None else p.decode(x))

    return rows.withColumn(out, text(ids_col))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_tokens, ids, round_trip (the decoded ids are the text)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))
