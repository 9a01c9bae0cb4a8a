"""Texts over a size limit cut into pieces at natural boundaries, with an overlap.

Sizes are estimated tokens: code points divided by four, rounded down. The piece count is the least with which pieces of the greatest size
that share the whole overlap cover the text. Its pieces of equal length, overlaps included, give the targets; each target is snapped
to the strongest boundary near it (paragraph, line, sentence, clause, blank; the nearest of equals) from which the rest can still be
covered, and a piece is added whenever one would break the limit. A piece starts up to ``overlap`` tokens before the end of the one before, at
the strongest boundary in the first half of that stretch, else at the nearest to its middle in the second, and where there is none it takes the whole stretch: each shares
text with the one before if ``overlap`` is not 0. Joining the pieces without their overlaps gives the text back exactly.

Only oversized texts leave the JVM; all others pass through as one piece.

Defined results: null texts are one piece with a null text and no tokens; empty and blank texts are one piece; a text without any
boundary is cut at the targets. Other columns are kept; those named like the new ones are replaced. An empty table gives no pieces.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUNDARIES = [(5, re.compile(r"\n[^\S\n]*\n\s*")), (4, re.compile(r"\n\s*")), (3, re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+")), (2, re.compile(r"[,;:、，]\s+")), (1, re.compile(r"\s+"))]
NAMES = {5: "paragraph", 4: "line", 3: "sentence", 2: "clause", 1: "blank", 0: "none"}


def boundary_near(text: str, target: int, low: int, high: int) -> tuple[int, int]:
    """(strength, position) of the strongest boundary in [low, high], the nearest to ``target`` of equals; positions are where
    the next piece may start."""
    for strength, p in BOUNDARIES:
        best = None
        at = max(0, low - 40)
        while (m := p.search(text, at)) and m.start() < high:
            if low <= m.end() <= high and (best is None or abs(m.end() - target) < abs(best - target)):
                best = m.end()
            at = m.end()
        if best is not None:
            return strength, best
    return 0, min(max(target, low), high)


def overlap_start(text: str, end: int, shared: int, after: int) -> int:
    """Where the piece behind a cut at ``end`` starts; ``after`` the start of the piece before."""
    low = max(end - shared, after + 1)
    half = max(low, end - (shared + 1) // 2)
    for first, last in ((low, half), (half, end - 1)):
        if first <= last:
            strength, at = boundary_near(text, first, first, last)
            if strength:
                return at
    return min(low, end)


def pieces(text: str, limit: int, overlap: int, slack: float = 0.2) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of each piece, in code points."""
    most, shared = 4 * limit + 3, min(4 * overlap, 2 * limit)
    n = len(text)
    if n <= most:
        return [(0, n, 5)]
    count = max(2, -(-(n - shared) // (most - shared)))
    while True:
        step = (n - shared) / count  # what a piece adds to the ones before
        out, start, end = [], 0, 0
        for i in range(count):
            if i == count - 1:
                strength, end = 5, n
            else:
                target = round(shared + step * (i + 1))
                reach = int(slack * step)
                # What is left behind the cut has to fit into the pieces left, overlaps included.
                low = max(end + 1, target - reach, n - (count - 1 - i) * (most - shared))
                high = min(n - 1, target + reach, start + most)
                if low > high:
                    break
                strength, end = boundary_near(text, target, low, high)
            if end - start > most:
                break
            out.append((start, end, strength))
            if i < count - 1:
                start = overlap_start(text, end, shared, start) if shared else end
        else:
            return out
        count += 1


def split_oversized(df: DataFrame, text: str, limit: int = 1000, overlap: int = 50) -> DataFrame:
    """All columns of ``df``, ``text`` replaced by each piece's, with piece_no, n_pieces, piece_start, piece_end, boundary and token_count."""
    new = ["piece_no", "n_pieces", "piece_start", "piece_end", "boundary", "token_count"]
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new])
    size = F.char_length(f"`{text}`")
    big = F.floor(size / 4) > limit

    @F.pandas_udf("array<struct<piece_no:int,n_pieces:int,piece_start:int,piece_end:int,boundary:string>>")
    def cuts(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            ps = pieces(t, limit, overlap)
            out.append([{"piece_no": k, "n_pieces": len(ps), "piece_start": s, "piece_end": e, "boundary": NAMES[w]} for k, (s, e, w) in enumerate(ps)])
        return pd.Series(out, dtype=object)

    whole = base.where(~big | F.col(f"`{text}`").isNull()).select(
        "*", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_start"), F.coalesce(size, F.lit(0)).alias("piece_end"), F.lit("paragraph").alias("boundary")
    )
    parts = base.where(big).withColumn("_c", F.explode(cuts(f"`{text}`"))).select("*", "_c.*").drop("_c")
    piece = F.substring(F.col(f"`{text}`"), F.col("piece_start") + 1, F.col("piece_end") - F.col("piece_start"))
    parts = parts.withColumn(text, piece).select(*whole.columns)
    out = whole.unionByName(parts)
    return out.withColumn("token_count", F.floor((F.col("piece_end") - F.col("piece_start")) / 4).cast("int"))
