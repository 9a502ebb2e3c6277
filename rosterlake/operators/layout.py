"""Text lines with boxes to label/value pairs: nearest neighbours and cells, per page.

Lines: page_id, i, text, x0, y0, x1, y1, hand (boolean), th (median text height
of the page). All pairs stay within a page and a horizontal band, so a page's
lines are never multiplied with another's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_rtl


def bands(lines: DataFrame) -> DataFrame:
    """Adds cy, cx and band: the row of the page, as tall as its text."""
    return lines.withColumn("cy", (F.col("y0") + F.col("y1")) / 2).withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("band", F.floor(F.col("cy") / F.col("th")).cast("int"))


def reading_order(lines: DataFrame, height: int = 20) -> DataFrame:
    """place: by bands of ``height`` pixels from the top, then from the left."""
    w = Window.partitionBy("page_id").orderBy(F.floor((F.col("y0") + F.col("y1")) / 2 / height), "x0", "i")
    return lines.withColumn("place", F.row_number().over(w))


def _nearby(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of a value and a label of its own or a neighbouring band."""
    v = bands(values).withColumn("b", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    lab = bands(labels).select("page_id", F.col("band").alias("b"), *[F.col(c).alias(f"l_{c}") for c in ("i", "text", "x0", "y0", "x1", "y1", "cy", "cx")])
    return v.join(lab, ["page_id", "b"]).where("i <> l_i")


def label_pairs(lines: DataFrame, reach: float = 12.0) -> DataFrame:
    """page_id, i, label_i, label, text, score: each value (handwriting) with the printed label nearest on its row.

    To the left, for right-to-left labels to the right, within ``reach`` text
    heights; the score is the vertical distance plus a twentieth of the horizontal.
    """
    pairs = _nearby(lines.where("hand"), lines.where("not hand"))
    rtl = is_rtl(F.col("l_text"))
    gap = F.when(rtl, F.col("l_x0") - F.col("x1")).otherwise(F.col("x0") - F.col("l_x1"))
    dy = F.abs(F.col("cy") - F.col("l_cy"))
    near = pairs.withColumn("gap", gap).withColumn("dy", dy).where((F.col("dy") <= 0.6 * F.col("th")) & (F.col("gap") >= -0.5 * F.col("th")) & (F.col("gap") <= reach * F.col("th")))
    scored = near.withColumn("score", F.col("dy") + 0.05 * F.greatest("gap", F.lit(0)))
    best = Window.partitionBy("page_id", "i").orderBy("score", "l_i")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("page_id", "i", F.col("l_i").alias("label_i"), F.col("l_text").alias("label"), "text", "score")


def attach_rest(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """page_id, i, label_i, label, text: handwriting without a label on its row takes the nearest printed text above it that overlaps it."""
    left = lines.where("hand").join(pairs.select("page_id", "i"), ["page_id", "i"], "left_anti")
    v = bands(left).withColumn("b", F.explode(F.sequence(F.col("band") - 3, F.col("band"))))
    lab = bands(lines.where("not hand")).select("page_id", F.col("band").alias("b"), F.col("i").alias("l_i"), F.col("text").alias("l_text"), F.col("x0").alias("l_x0"), F.col("x1").alias("l_x1"), F.col("cy").alias("l_cy"))
    above = v.join(lab, ["page_id", "b"]).where("l_cy < cy and l_x0 < x1 and x0 < l_x1")
    w = Window.partitionBy("page_id", "i").orderBy(F.col("cy") - F.col("l_cy"), "l_i")
    return above.withColumn("r", F.row_number().over(w)).where("r = 1").select("page_id", "i", F.col("l_i").alias("label_i"), F.col("l_text").alias("label"), "text")


def in_cells(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """page_id, i, text, row, col (from 0): lines whose centre lies in a cell. tables: page_id, xs, ys (sorted edges, a row per page)."""
    at = lambda edges, v: F.size(F.filter(edges, lambda e: e <= v)) - 1
    rows = lines.join(tables, "page_id").withColumn("row", at(F.col("ys"), (F.col("y0") + F.col("y1")) / 2)).withColumn("col", at(F.col("xs"), (F.col("x0") + F.col("x1")) / 2))
    return rows.where("row >= 0 and col >= 0 and row < size(ys) - 1 and col < size(xs) - 1").select("page_id", "i", "text", "row", "col")


def in_zones(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """page_id, i, zone_id: lines whose centre lies in a rectangle of their page. zones: page_id, zone_id, zx0, zy0, zx1, zy1."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return lines.join(zones, "page_id").where(cx.between(F.col("zx0"), F.col("zx1")) & cy.between(F.col("zy0"), F.col("zy1"))).select("page_id", "i", "zone_id")


def personal_zones(lines: DataFrame, personal: Column, reach: float = 12.0) -> DataFrame:
    """page_id, x0, y0, x1, y1: rectangles over personal labels and what follows on their row, up to the next printed label."""
    rows = bands(lines).withColumn("personal", personal)
    w = Window.partitionBy("page_id", "band").orderBy("x0", "i")
    stop = F.min(F.when(~F.col("hand"), F.col("x0"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    right = F.max("x1").over(Window.partitionBy("page_id", "band"))
    zone = rows.withColumn("end", F.coalesce(stop, right)).where("personal")
    return zone.select("page_id", "x0", "y0", F.greatest("x1", F.least("end", F.col("x1") + reach * F.col("th"))).alias("x1"), "y1")


def lines_of_gaps(positions: DataFrame, key: str, at: str, weight: str, gap: float) -> DataFrame:
    """key, at (weighted mean), weight: positions closer than gap to the one before are one line."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    rows = positions.withColumn("__n", new).withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "__g").agg((F.sum(F.col(at) * F.col(weight)) / F.sum(weight)).alias(at), F.sum(weight).alias(weight)).drop("__g")


def box_state(ratio: Column, on: float = 0.03, off: float = 0.01) -> Column:
    """True, false, or null in between."""
    return F.when(ratio >= on, True).when(ratio <= off, False)


def combine_readings(ocr: Column, second: Column, confidence: Column, same: Column, format_ok: Column, text_kind: Column, threshold: float = 0.7) -> Column:
    """struct<value, status, confidence> of a first and a second reading of one value; the first branch that fits counts.

    same: both readings are the same value; format_ok: the second one parses.
    """
    from ..functions.text import special_word

    none = F.lit(None).cast("string")
    made = lambda v, s, c: F.struct(v.alias("value"), (F.lit(s) if isinstance(s, str) else s).alias("status"), c.cast("double").alias("confidence"))
    empty, had = F.coalesce(F.trim(second), F.lit("")).isin("", "EMPTY"), F.coalesce(F.trim(ocr), F.lit("")) != ""
    unknown = special_word(second) == "unknown"
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    high = F.greatest(confidence, F.lit(0.85))
    return (
        F.when(empty & ~had, made(none, "NOT_PROVIDED", F.lit(0.7))).when(empty, made(ocr, "NEEDS_REVIEW", F.least(confidence, F.lit(0.5))))
        .when((second == "ILLEGIBLE") & ~had, made(none, "ILLEGIBLE", F.lit(0.5))).when(second == "ILLEGIBLE", made(ocr, "NEEDS_REVIEW", F.lit(0.5)))
        .when(unknown & (special_word(ocr) == "unknown"), made(none, "UNKNOWN", F.lit(0.5))).when(unknown, made(none, "NEEDS_REVIEW", F.lit(0.5)))
        .when(same & format_ok, made(second, F.when(high >= threshold, "KNOWN").otherwise("NEEDS_REVIEW"), high))
        .when(same, made(second, F.lit("NEEDS_REVIEW" if 0.5 < threshold else "KNOWN"), F.lit(0.5)))
        .when(text_kind & (plain(ocr) == plain(second)), made(second, "KNOWN", F.greatest(F.least(confidence, F.lit(0.9)), F.lit(threshold))))
        .otherwise(made(F.when(format_ok | ~had, second).otherwise(ocr), "NEEDS_REVIEW", F.when(had, 0.5).otherwise(0.6)))
    )


def split_mixed(text: Column, share: Column) -> Column:
    """struct<label, value> of a line that holds print and handwriting, null where it can't be cut.

    share: the printed part of the line's width. The cut is behind the first
    colon, else there in proportion, or behind the nearest space within three
    characters of it.
    """
    n, colon = F.length(text), F.regexp_instr(text, F.lit("[:;]"))
    at = F.rint(share * n).cast("int")
    spaces = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i + 1, F.lit(1)) == " ")
    near = F.array_min(F.transform(spaces, lambda i: F.struct(F.abs(i - at).alias("d"), i.alias("i"))))
    cut = F.when(colon > 0, colon).when(near["d"] <= 3, near["i"] + 1).otherwise(at)
    label, value = F.trim(F.substring(text, F.lit(1), cut)), F.trim(F.substring(text, cut + 1, n))
    fits = (n >= 4) & share.between(0.2, 0.85) & (F.length(label) >= 2) & (F.length(value) >= F.when(colon > 0, 1).otherwise(2))
    return F.when(fits, F.struct(label.alias("label"), value.alias("value")))


# The signs that stand for a box in read text.
BOX_GLYPHS = "[□■☐☑☒✓✔✗✘▢◻]"


def numbered_boxes(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """page_id, box_id, label: boxes of a numbered row carry the numbers of their row from the left.

    boxes: page_id, box_id, x, y, w, h, label, th. Boxes with one title and a
    number, closer than 0.8 text heights from one to the next, are a row;
    boxes without a label at its height belong to it, up to six box widths
    beyond its ends, and to the nearest row only. The numbers are those read on
    the row's lines if there are as many as boxes, else 1, 2, and so on. Other
    boxes keep their labels. A page's rows never meet another page's.
    """
    height = F.col("y") + F.col("h") / 2
    b = boxes.withColumn("cy", height).withColumn("title", F.regexp_extract("label", r"^(.*?)\s*(\d{1,2})$", 1)).withColumn("has", F.coalesce(F.col("label").rlike(r"^.*?\s*\d{1,2}$"), F.lit(False)))
    w = Window.partitionBy("page_id", "title").orderBy("cy", "x", "box_id")
    new = F.when(F.col("cy") - F.lag("cy").over(w) < 0.8 * F.col("th"), 0).otherwise(1)
    named = b.where("has").withColumn("new", new).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    row = ["page_id", "title", "g"]
    rows = named.groupBy(*row).agg(F.min("x").alias("from_x"), F.max("x").alias("to_x"), F.min_by("cy", F.struct("x", "box_id")).alias("row_y"), F.min_by("w", F.struct("x", "box_id")).alias("box_w"), F.max("th").alias("row_th"))
    bare = b.where("coalesce(label, '') = ''").select("page_id", "box_id", "x", "cy").join(rows, "page_id")
    near = bare.withColumn("d", F.abs(F.col("cy") - F.col("row_y"))).where((F.col("d") < 0.8 * F.col("row_th")) & F.col("x").between(F.col("from_x") - 6 * F.col("box_w"), F.col("to_x") + 6 * F.col("box_w")))
    taken = near.groupBy("page_id", "box_id").agg(F.min_by(F.struct("title", "g", "x"), F.struct("d", "title", "g")).alias("r")).select("page_id", "r.title", "r.g", "box_id", "r.x")
    members = named.select(*row, "box_id", "x").union(taken)
    text = lines.select("page_id", "i", "text", "x0", ((F.col("y0") + F.col("y1")) / 2).alias("at")).join(rows, "page_id").where(F.abs(F.col("at") - F.col("row_y")) < 0.8 * F.col("row_th"))
    read = text.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("x0", "i", "text"))).alias("l")).select(
        *row, F.regexp_extract_all(F.regexp_replace(F.array_join("l.text", " "), BOX_GLYPHS, " "), F.lit(r"\d{1,2}"), F.lit(0)).alias("digits"))
    along = Window.partitionBy(*row)
    placed = members.withColumn("k", F.row_number().over(along.orderBy("x", "box_id"))).withColumn("n", F.count("*").over(along)).join(read, row, "left")
    number = F.when(F.size("digits") == F.col("n"), F.get("digits", F.col("k") - 1)).otherwise(F.col("k").cast("string"))
    renamed = placed.select("page_id", "box_id", F.trim(F.concat_ws(" ", "title", number)).alias("renamed"))
    return boxes.select("page_id", "box_id", "label").join(renamed, ["page_id", "box_id"], "left").select("page_id", "box_id", F.coalesce("renamed", "label").alias("label"))
