"""Fill-in-the-middle transformation: a text is cut at two ranks of its lines into prefix, middle and suffix, and written
with markers as prefix-suffix-middle (psm) or suffix-prefix-middle (spm).

Lines are indexed by an indexable skip list: each line has a node, a node of height h is linked on the lanes below h, and
every link carries two widths, the lines and the code points that it steps over. A cut rank is reached by descending from the
sparsest lane: a lane is followed while the accumulated lines don't pass the rank, and the code points accumulated on the
way are the place of the cut. Heights come from the trailing zero bits of a mixed line number, so reruns agree.

Ranks and forms are drawn from sha256 of seed and doc_id, not from the order of rows.

Nulls and corner cases: a null text counts as empty; an empty text and a text that holds a marker stay plain. A null doc_id
draws like the empty string. Rows that repeat a doc_id draw the same numbers. A text without a line break is one line. An
empty table gives no row. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SEED = 7
#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, how many are transformed, and of a hundred of these, how many as suffix-prefix-middle.
FIM_PERCENT, SPM_PERCENT = 100, 50
#: A node reaches the next lane where this many more low bits of its mixed number are zero: one of four does.
LANE_BITS = 2


class SkipList:
    """Units of the given widths under express lanes: ``lanes[l]`` has the links of lane l in order, as the units and the
    code points that each steps over."""

    def __init__(self, widths: np.ndarray):
        unit_width, char_width = np.ones(len(widths), np.int64), np.asarray(widths, np.int64)
        mixed = np.arange(1, len(widths) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        self.lanes: list[tuple[np.ndarray, np.ndarray]] = []
        self.down: list[np.ndarray] = []  # links passed on the lane below when so many are passed on this one
        while len(unit_width):
            self.lanes.append((unit_width, char_width))
            tall = np.flatnonzero(mixed & np.uint64((1 << LANE_BITS * len(self.lanes)) - 1) == 0)
            # a link of the next lane ends at a tall node and steps over what the links up to it step over
            unit_width, char_width, mixed = np.diff(np.cumsum(unit_width)[tall], prepend=0), np.diff(np.cumsum(char_width)[tall], prepend=0), mixed[tall]
            self.down.append(np.concatenate([[0], tall + 1]))

    def place(self, rank: int) -> int:
        """The code points before the unit of this rank (0-based; one past the last is the end)."""
        units = chars = at = 0
        for lane in range(len(self.lanes) - 1, -1, -1):
            unit_width, char_width = self.lanes[lane]
            while at < len(unit_width) and units + unit_width[at] <= rank:
                units += int(unit_width[at])
                chars += int(char_width[at])
                at += 1
            if lane:
                at = int(self.down[lane - 1][at])
        return chars


def line_widths(text: str) -> np.ndarray:
    """Code points of each line with its line break."""
    lines = text.split("\n")
    widths = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


def draws(doc_id, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]


def transformed(doc_id, text: str, seed: int = SEED, markers=MARKERS, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT):
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    widths = line_widths(text)
    n = len(widths)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in markers) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    lines = SkipList(widths)
    a, b = lines.place(low), lines.place(high)
    p, s, m = markers
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(docs: DataFrame, seed: int = SEED, markers: tuple[str, str, str] = MARKERS, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: every document transformed, with its number of lines and
    the code points of prefix and middle (null where the text stays plain). Markers must not share characters at their
    ends, as those of ``MARKERS`` don't, so that one never arises across a seam."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                done = [transformed(i, t or "", seed, markers, fim_percent, spm_percent) for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())]
                n, form, prefix, middle, output = zip(*done)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text that ``fill_in_middle`` was given, from its output and form alone."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)  # "", then three parts in the order of the form
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


ORACLE_FIM = rf"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
ranks AS (
  SELECT doc_id, t, lines, len(lines) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(lines) + 1) AS h1, CAST('0x' || h[9:16] AS BIGINT) % (len(lines) + 1) AS h2,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= {FIM_PERCENT} AS plain,
    CAST('0x' || h[25:32] AS BIGINT) % 100 < {SPM_PERCENT} AS spm
  FROM drawn),
cut AS (
  SELECT *, array_to_string(lines[1:least(h1, h2)], '') AS p, array_to_string(lines[least(h1, h2) + 1:greatest(h1, h2)], '') AS m,
    array_to_string(lines[greatest(h1, h2) + 1:], '') AS s
  FROM ranks)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
