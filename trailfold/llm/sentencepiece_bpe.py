"""SentencePiece encoding and decoding, exact for merge-type models.

A tokenisation is the one that merging gives exactly if every pair of
neighbours is: re-merging the text of two neighbours has to give these two
tokens back.  So the encoder walks left to right over longest matches (one
Aho-Corasick pass), keeps a match only if it is compatible with the token
before it, tries shorter prefixes, and steps back where none fits; a bitfield
marks the positions from which no tokenisation can be completed, so none is
tried twice.  Characters outside the vocabulary become byte tokens and cut
the text, as no merge crosses them.

Where no piece holds two neighbouring characters of certain kinds, no merge
crosses between them: this vocabulary has the space mark only in front of a
piece, and never a letter beside another kind of character (checked when it is
loaded).  The text falls apart there, and repeated words are encoded once per
task (bounded memos).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from trailfold.llm.common import text_slices

MARK = "▁"
WORDS = regex.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
RUNS = regex.compile(rf"{MARK}*\p{{L}}+|{MARK}*[^\p{{L}}{MARK}]+|{MARK}+")
#: Entries of a task's memos of words, and of runs and pairs; a full memo starts anew.
WORDS_KEPT, RUNS_KEPT = 300_000, 800_000


class PieceModel:
    """The vocabulary of a merge-type model with byte fallback: encode and decode."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
                   for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.characters = frozenset(p for p in self.ids if len(p) == 1)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unspelled = self.silent | set(self.byte_of)
        if len(self.byte_ids) != 256:
            raise ValueError("needs byte fallback")
        # a piece that would be cut: then only whole texts are independent
        self.whole = any(len(RUNS.findall(p)) > 1 for p in self.ids)
        self.matcher = ahocorasick.Automaton()
        for p in self.ids:
            self.matcher.add_word(p, len(p))
        self.matcher.make_automaton()
        # the longest piece that is a proper prefix of each piece
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), "") for p in self.ids}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[str, tuple[str, str]] = {}
        self.words: dict[str, tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Merging itself: again and again the best pair of neighbours, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        queue = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (score := self.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-score, i, j, len(parts[i]) + len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > RUNS_KEPT:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[str]:
        """Tokens of ``text``, whose characters are all pieces."""
        longest = [0] * len(text)
        for end, size in self.matcher.iter(text):
            at = end - size + 1
            if size > longest[at]:
                longest[at] = size
        open_at = bytearray(b"\1") * (len(text) + 1)
        tokens: list[str] = []
        at, token = 0, text[:longest[0]]
        while True:
            last = tokens[-1] if tokens else None
            while token and not (open_at[at + len(token)] and (last is None or self.compatible(last, token))):
                token = self.shorter[token]
            if token:
                tokens.append(token)
                at += len(token)
                if at == len(text):
                    return tokens
                token = text[at:at + longest[at]]
            else:
                open_at[at] = 0
                token = tokens.pop()
                at -= len(token)

    def unit(self, text: str) -> list[int]:
        """Ids of a text with space marks, cut at characters that are no pieces."""
        if self.characters.issuperset(text):
            return [self.ids[t] for t in self.backtrack(text)]
        out: list[int] = []
        first = 0
        for i, c in enumerate(text):
            if c not in self.characters:
                if i > first:
                    out += [self.ids[t] for t in self.backtrack(text[first:i])]
                out += [self.byte_ids[b] for b in c.encode()]
                first = i + 1
        if first < len(text):
            out += [self.ids[t] for t in self.backtrack(text[first:])]
        return out

    def run_of(self, text: str) -> tuple[str, str]:
        """The ids of an independent run as text, and the text that they decode to."""
        got = self.runs.get(text)
        if got is None:
            if len(self.runs) > RUNS_KEPT:
                self.runs.clear()
            ids = self.unit(text)
            got = self.runs[text] = (",".join(map(str, ids)), self.spelled(ids))
        return got

    def word(self, text: str) -> tuple[str, str]:
        """The same for a word with its space mark: one or more runs."""
        got = self.words.get(text)
        if got is None:
            if len(self.words) > WORDS_KEPT:
                self.words.clear()
            runs = [self.run_of(r) for r in RUNS.findall(text)]
            got = self.words[text] = (",".join([r[0] for r in runs]), "".join([r[1] for r in runs]))
        return got

    def parts(self, text: str) -> list[tuple[str, str]]:
        """Ids and spelling of a text, run by run or word by word."""
        if not text:
            return []
        if self.whole:
            ids = self.unit(MARK + text.replace(" ", MARK))
            return [(",".join(map(str, ids)), self.spelled(ids))]
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            words = WORDS.findall(MARK + text.replace(" ", MARK))
        else:
            words = [MARK + w for w in text.split(" ")]
        memo = self.words
        return [memo[w] if w in memo else self.word(w) for w in words]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.parts(text) for i in ids.split(",")]

    def spelled(self, ids: list[int]) -> str:
        if self.unspelled.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i >= 0 and i not in self.silent:
                out.append(self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``; the space that encoding puts in front goes again."""
        text = self.spelled(ids)
        first = next((i for i in ids if i not in self.silent), -1)
        return text[1:] if first >= 0 and self.pieces[first].startswith(MARK) else text


def _utf8(raw: bytes) -> str:
    """Bytes to text; each byte outside a whole character becomes one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in range(1, 5):
            try:
                out.append(raw[at:at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _joined(model: PieceModel, text: str) -> tuple[str, str]:
    """All ids of a text joined by commas, and the text that they decode to.

    The runs' spellings put together are ``decode`` of all ids: a run ends
    with a whole character, so bytes never join across runs; only the first
    space goes.
    """
    parts = model.parts(text)
    return ",".join([p[0] for p in parts]), "".join([p[1] for p in parts])[1:]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Per row: ``n_tokens``, hash of the ids, hash of the decoded text (and ``ids`` if asked).

    Every row of ``docs`` gives one row, repeated rows too; a null text is an
    empty one (no tokens, hashes of the empty string); a null id stays null.
    Other columns are not read.  Map-only: no shuffle, and a task holds some
    MB of text and a bounded memo.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for part in text_slices(batches, "text"):
            rows = [_joined(model, t or "") for t in part.column("text").to_pylist()]
            counts = [ids.count(",") + 1 if ids else 0 for ids, _ in rows]
            cols = [part.column("id"), pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(a.encode()).hexdigest() for a, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for _, b in rows], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([[int(x) for x in a.split(",")] if a else [] for a, _ in rows],
                                     pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return (docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
            .mapInArrow(run, schema).withColumnRenamed("id", id_col))


def decode_documents(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an id list (null: null) to every row."""
    schema = rows.drop(out).schema.add(out, "string")
    kept = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for b in batches:
            texts = [None if ids is None else model.decode(ids) for ids in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return kept.mapInArrow(run, schema)
