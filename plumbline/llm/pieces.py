"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model holds a whitespace marker behind another character, so a merge never joins the end
of one marked word to the start of the next.  A text is therefore cut before every run of markers, each
distinct marked word of a task is segmented once, and the ids are put back by position.  Tasks share
nothing, so there is no shuffle, and a lost executor costs only its own tasks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from plumbline.llm.common import schema_with, slices

MARK = "▁"
_MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def _processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_model(model: bytes) -> None:
    """Refuse a model whose pieces cross a marker or whose normalisation is not the identity."""
    sp = _processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece crosses a whitespace marker")
    for probe in ("Ａ　x  y", "  \tz\n"):
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model changes characters before it cuts")


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace column `text` by `ids`, an array of the ids that the library gives for the whole text.

    Without begin and end ids.  A null or empty text gives an empty array.  All other columns are kept, in
    any number and order; rows are never joined to each other, so repeated rows and keys do not matter.
    """
    check_model(model)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        sp = _processor(shipped.value)
        number: dict[str, int] = {}
        flat, starts, lengths = np.zeros(1 << 16, np.int32), [], []
        used = 0
        for part in slices(batches, text):
            at = part.schema.get_field_index(text)
            words, counts = [], []
            for value in part.column(at).to_pylist():
                found = _MARKED_WORD.findall(MARK + value.replace(" ", MARK)) if value else []
                words += found
                counts.append(len(found))
            fresh = [w for w in dict.fromkeys(words) if w not in number]
            # the library puts one marker in front of what it is given, so the first one is left off
            for word, got in zip(fresh, sp.encode([w[1:] for w in fresh], num_threads=1) if fresh else [], strict=True):
                if not got:  # a lone marker: what a closing space adds to a text
                    got = sp.encode("a ")[len(sp.encode("a")) :]
                number[word] = len(starts)
                starts.append(used)
                lengths.append(len(got))
                if used + len(got) > len(flat):
                    flat = np.concatenate([flat, np.zeros(max(len(flat), len(got)), np.int32)])
                flat[used : used + len(got)] = got
                used += len(got)
            place = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            first, size = np.asarray(starts, np.int64)[place], np.asarray(lengths, np.int64)[place]
            ends = np.cumsum(size)
            position = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            values = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat[position], pa.int32()))
            columns = [part.column(i) for i in range(part.num_columns) if i != at]
            names = [n for i, n in enumerate(part.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, values], [*names, ids])

    return df.mapInArrow(run, schema_with(df, (text,), f"`{ids}` array<int>"))


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Replace the array column `ids` by `text`, what the library's decode(ids) returns.

    Null or empty arrays give the empty text.  Byte pieces that form no valid character go through the
    library itself.  An id outside the vocabulary fails as it does there.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        sp = _processor(shipped.value)
        size = sp.get_piece_size()
        ruled = np.array([sp.is_control(i) or sp.is_unknown(i) for i in range(size)])
        spelled = [
            b"" if ruled[i] else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(size)
        ]
        letters = np.frombuffer(b"".join(spelled), np.uint8)
        width = np.fromiter(map(len, spelled), np.int64, size)
        first = np.cumsum(width) - width
        for part in batches:
            at = part.schema.get_field_index(ids)
            lists = part.column(at)
            out = []
            for i in range(part.num_rows):
                own = lists[i].values
                if own is None or not len(own):
                    out.append("")
                    continue
                own = own.to_numpy(zero_copy_only=False)
                if own.min() < 0 or own.max() >= size or ruled[own].any():
                    out.append(sp.decode(own.tolist()))
                    continue
                n = width[own]
                ends = np.cumsum(n)
                raw = letters[np.arange(ends[-1]) + np.repeat(first[own] - (ends - n), n)].tobytes()
                try:
                    out.append((raw[1:] if raw[:1] == b" " and spelled[own[0]][:1] == b" " else raw).decode())
                except UnicodeDecodeError:
                    out.append(sp.decode(own.tolist()))
            columns = [part.column(i) for i in range(part.num_columns) if i != at]
            names = [n for i, n in enumerate(part.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], [*names, text])

    return df.mapInArrow(run, schema_with(df, (ids,), f"`{text}` string"))
