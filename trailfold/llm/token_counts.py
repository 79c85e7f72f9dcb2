"""Token counts of whole texts; huge ones by overlapping chunks and resynchronisation.

Texts up to ``chunk`` characters are encoded whole.  A longer one is encoded
in chunks that overlap, with offsets, so that memory is bounded by a chunk.
Two neighbouring chunks are spliced at a token that both have, with the same
id, start and end: a sequence of merge-type tokens is the one that merging
gives exactly if every two neighbours are what merging their own text gives,
and around the shared token every pair of neighbours stands in one chunk or
the other.  So the spliced sequence is the one for the whole text, whatever
lies further away.  Where the overlap has no such token it is doubled, at last
to the whole chunk, and then the chunks themselves are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from trailfold.llm.common import text_slices

CHUNK, OVERLAP = 1 << 15, 256
MARK = "▁"


@lru_cache(maxsize=2)
def _pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def _spans(model: sentencepiece.SentencePieceProcessor, raw: bytes, begin: int, end: int) -> list[tuple[int, int, int]]:
    """(start, end, id) of each token of a chunk, in bytes of the whole; bytes and bare space marks get no id."""
    found = model.encode(raw[begin:end].decode(), return_type="proto").pieces
    return [(begin + p.begin, begin + p.end, -1 if model.is_byte(p.id) or not p.piece.strip(MARK) else p.id)
            for p in found]


def count_in_chunks(model: sentencepiece.SentencePieceProcessor, text: str, chunk: int = CHUNK,
                    overlap: int = OVERLAP) -> int:
    """Tokens of the whole ``text``, encoded chunk by chunk (sizes in bytes, moved to whole characters)."""
    raw = text.encode()

    def whole(at: int) -> int:
        at = min(at, len(raw))
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    first, end = 0, whole(max(chunk, 4))
    tokens = _spans(model, raw, 0, end)
    total = entry = 0
    while end < len(raw):
        width = min(max(overlap, 4), end - first)
        while True:
            begin = whole(end - width)
            ahead = whole(end + max(chunk, 4))
            follow = _spans(model, raw, begin, ahead)
            # the first token of a chunk also holds the space put in front: it proves nothing
            known = {t: i for i, t in enumerate(tokens) if i >= entry and t[0] > begin and t[2] >= 0}
            shared = next((j for j, t in enumerate(follow) if t in known), None)
            if shared is not None:
                total += known[follow[shared]] - entry
                first, end, tokens, entry = begin, ahead, follow, shared
                break
            if begin > first:
                width = min(2 * width, end - first)
                continue
            # nothing is shared even with the whole chunk: begin anew with longer ones
            return count_in_chunks(model, text, 2 * chunk, overlap)
    return total + len(tokens) - entry


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``path`` names a sentencepiece ``.model`` of the merge type, or a
    tokenizers ``.json``, whose texts are encoded whole.  Every row gives one,
    repeated rows too; a null text counts as empty: no bytes, no tokens; a
    null id stays null.  Other columns are not read.  Map-only, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            if path.endswith(".json"):
                model = _tokenizer(path)
                counts = [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
            else:
                model = _pieces(path)
                counts = [len(model.encode(t)) if len(t) <= chunk else count_in_chunks(model, t, chunk, overlap)
                          for t in texts]
            sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), sizes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                ["id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
            .mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
            .withColumnRenamed("id", id_col))
