"""Frames and masks: features, admissibility, pixel votes, field-of-view boxes, popups and routing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, fixed
from . import kernels

FRAME = ("recording_id", "frame_index")
_LONG = tuple(f"cast({c} as long) as {c}" for c in FRAME)


def histogram(pixels: DataFrame) -> DataFrame:
    """Pixels of each class in each frame, zeros included."""
    return pixels.groupBy(*FRAME).agg(*(F.count_if(F.col("cls") == k).alias(f"n_{k}") for k in range(4)))


def features(pixels: DataFrame, gradient: Column | None = None) -> DataFrame:
    """Dynamic range (99th less 1st percentile), crushed and saturated shares of each frame's gray values.

    ``gradient`` is any column over pixels whose mean is the frame's gradient.
    """
    tails = F.percentile("gray", F.array(F.lit(0.01), F.lit(0.99)))
    aggs = [(tails[1] - tails[0]).alias("dynamic_range"), F.avg((F.col("gray") <= 2).cast("int")).alias("crushed"), F.avg((F.col("gray") >= 253).cast("int")).alias("saturated")]
    if gradient is not None:
        aggs.append(F.avg(gradient).alias("gradient"))
    return pixels.groupBy(*FRAME).agg(*aggs)


def frame_features(frames: DataFrame) -> DataFrame:
    """The same with the Sobel gradient, from frames (recording_id, frame_index, width, height, pixels as B, G, R bytes)."""

    def run(batches):
        for batch in batches:
            rows = [kernels.frame_features(np.frombuffer(p, np.uint8).reshape(h, w, 3)) for w, h, p in zip(*(batch.column(n).to_pylist() for n in ("width", "height", "pixels")), strict=True)]
            value = [pa.array([r[i] for r in rows], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("recording_id"), batch.column("frame_index"), *value], [*FRAME, "dynamic_range", "crushed", "saturated", "gradient"])

    return frames.selectExpr(*_LONG, "width", "height", "pixels").mapInArrow(run, "recording_id long, frame_index long, dynamic_range double, crushed double, saturated double, gradient double")


def inadmissible() -> Column:
    """Why a frame is not used for calibration, or null: the first check that fails, with its value."""
    low, crushed, bright, flat = (F.col(c) for c in ("dynamic_range", "crushed", "saturated", "gradient"))
    return (
        F.when(low < fixed.MIN_DYNAMIC_RANGE, F.format_string("dynamic range %.1f", low))
        .when(crushed > fixed.MAX_CRUSHED, F.format_string("crushed share %.3f", crushed))
        .when(bright > fixed.MAX_SATURATED, F.format_string("saturated share %.3f", bright))
        .when(flat < fixed.MIN_GRADIENT, F.format_string("gradient %.3f", flat))
    )


def admission(frames: DataFrame) -> DataFrame:
    """Kept and dropped frames of each recording, and whether enough are kept; the reason is the first dropped frame's."""
    why = frames.withColumn("why", inadmissible())
    out = why.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if(F.col("why").isNull()).alias("n_kept"),
        F.min_by("why", F.when(F.col("why").isNotNull(), F.col("frame_index"))).alias("first_reason"),
    )
    share = F.col("n_kept") / F.col("n_frames")
    admitted = share >= fixed.MIN_VALID_SHARE
    return out.select("recording_id", "n_frames", "n_kept", share.alias("retained"), admitted.alias("admitted"), F.when(~admitted, F.col("first_reason")).alias("reason"))


def agreement(pixels: DataFrame, share: float = fixed.AGREEMENT) -> DataFrame:
    """Pixel votes over a recording's masks: tissue and whole view, each true from ``share`` of the masks on.

    Partial sums go out once a pixel position and task, so the shuffle has the
    frame's size, not the recording's length.
    """
    _share("share", share, False)
    votes = pixels.groupBy("recording_id", "y", "x").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cls") == fixed.TISSUE).alias("n_tissue"), F.count_if(F.col("cls").isin(fixed.TISSUE, fixed.CORNER)).alias("n_view"))
    return votes.select("recording_id", "y", "x", "n", "n_tissue", "n_view", (F.col("n_tissue") / F.col("n") >= share).alias("tissue"), (F.col("n_view") / F.col("n") >= share).alias("view"))


def run_agreement(runs: DataFrame, masks: DataFrame, classes: tuple[int, ...], share: float = fixed.AGREEMENT) -> DataFrame:
    """The same vote over run-length rows (y, x_start, x_end, cls): stable runs by a running sum over their ends.

    ``masks`` has one row a mask, so that masks without a run count too. A row of
    pixels costs its runs, not its width.
    """
    _share("share", share, False)
    from pyspark.sql import Window

    counts = masks.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_masks"))
    ends = runs.where(F.col("cls").isin(*classes)).select("recording_id", "y", F.explode(F.array(F.struct(F.col("x_start").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x_end").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("recording_id", "y", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    line = Window.partitionBy("recording_id", "y").orderBy("x")
    cover = steps.withColumn("votes", F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("x_end", F.lead("x").over(line))
    return cover.join(counts, "recording_id").where((F.col("votes") / F.col("n_masks") >= share) & (F.col("x_end") > F.col("x"))).select("recording_id", "y", F.col("x").alias("x_start"), "x_end", "votes")


def popup_presence(pixels: DataFrame, frame_pixels: int, detector: bool = True, min_share: float = fixed.MIN_POPUP_SHARE, min_frames: float = fixed.MIN_POPUP_FRAMES) -> DataFrame:
    """Frames that show a popup in each recording, and whether the recording does."""
    _share("min_share", min_share, True)
    _share("min_frames", min_frames, True)
    need = max(1.0, min_share * frame_pixels)
    each = pixels.groupBy(*FRAME).agg(F.count_if(F.col("cls") == fixed.POPUP).alias("n"))
    out = each.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("n") >= need).alias("popup_frames"))
    share = F.col("popup_frames") / F.col("n_frames")
    return out.select("recording_id", "n_frames", "popup_frames", share.alias("popup_share"), (F.lit(detector) & (F.col("popup_frames") > 0) & (share >= min_frames)).alias("popup_present"))


def view_box(votes: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """Bounds of each recording's stable view; its bottom is at least the inner box's."""
    out = votes.where("view").groupBy("recording_id").agg(*(f(c).alias(n) for f, c, n in ((F.min, "x", "x1"), (F.min, "y", "y1"), (F.max, "x", "x2"), (F.max, "y", "y2"))))
    bottom = F.col("y2") + 1
    if inner is not None:
        out = out.join(inner.select("recording_id", F.col("box").alias("_inner")), "recording_id", "left")
        bottom = F.greatest(bottom, F.coalesce(F.col("_inner")["y2"], F.lit(0)))
    return out.select("recording_id", boxes.box(F.col("x1"), F.col("y1"), F.col("x2") + 1, bottom).alias("box"))


def preservation(votes: DataFrame, box_of: DataFrame, flag: str = "tissue") -> DataFrame:
    """Share of each recording's stable pixels inside its box; 0 without any."""
    b = F.col("box")
    inside = (F.col("x") >= b["x1"]) & (F.col("x") < b["x2"]) & (F.col("y") >= b["y1"]) & (F.col("y") < b["y2"])
    joined = votes.join(box_of.select("recording_id", "box"), "recording_id")
    return joined.groupBy("recording_id").agg(F.coalesce(F.try_divide(F.count_if(F.col(flag) & inside), F.count_if(flag)), F.lit(0.0)).alias("preserved"))


def warm(b: Column, g: Column, r: Column) -> Column:
    """Whether a colour is warm: hue up to 30 or from 165 of 180, saturation from 35, value from 25 (8-bit HSV)."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    spread = top - low
    hue = F.when(spread == 0, 0.0).when(top == r, 60.0 * (g - b) / spread).when(top == g, 120.0 + 60.0 * (b - r) / spread).otherwise(240.0 + 60.0 * (r - g) / spread)
    half = F.floor(F.when(hue < 0, hue + 360.0).otherwise(hue) / 2.0 + 0.5).cast("int") % 180
    full = F.when(top == 0, 0).otherwise(F.floor(255.0 * spread / top + 0.5).cast("int"))
    return ((half <= 30) | (half >= 165)) & (full >= 35) & (top >= 25)


def routing(pixels: DataFrame, candidates: DataFrame, width: int | Column, height: int | Column, min_support: float = fixed.MIN_SUPPORT) -> DataFrame:
    """Whether each frame's candidate box shows picture content: enough tissue inside it, or enough warm colour.

    ``candidates`` has a row a frame (box null: no candidate); width and height may be columns of it. Only frames with a
    box that reaches into the frame meet their pixels, by an equi join on the
    frame; the box test is a condition inside the aggregate.
    """
    c = candidates.select(*FRAME, "box", boxes.clamped(F.col("box"), F.lit(width), F.lit(height)).alias("clip"))
    clip = F.col("clip")
    w, h = clip["x2"] - clip["x1"], clip["y2"] - clip["y1"]
    dx, dy = F.greatest(F.lit(1), F.bround(w * fixed.INSET, 0).cast("int")), F.greatest(F.lit(1), F.bround(h * fixed.INSET, 0).cast("int"))
    x, y = F.col("x"), F.col("y")
    within = (x >= clip["x1"]) & (x < clip["x2"]) & (y >= clip["y1"]) & (y < clip["y2"])
    deep = (x >= clip["x1"] + dx) & (x < clip["x2"] - dx) & (y >= clip["y1"] + dy) & (y < clip["y2"] - dy)
    met = c.where(clip.isNotNull()).join(pixels, [*FRAME]).where(within)
    support = met.groupBy(*FRAME).agg(
        F.coalesce(F.avg(F.when(deep, F.col("cls").isin(fixed.TISSUE, fixed.CORNER).cast("int"))), F.lit(0.0)).alias("tissue"),
        F.avg(warm(F.col("b"), F.col("g"), F.col("r")).cast("int")).alias("warm"),
    )
    out = c.join(support, [*FRAME], "left")
    most = F.greatest("tissue", "warm")
    reason = F.when(F.col("box").isNull(), fixed.NO_FOOTPRINT).when(clip.isNull(), fixed.INVALID_POPUP).when(most >= min_support, fixed.OK).otherwise(fixed.NOT_ROUTED)
    return out.select(*FRAME, (reason == fixed.OK).alias("routed"), reason.alias("reason"), F.coalesce(most, F.lit(0.0)).alias("support"), F.coalesce("tissue", F.lit(0.0)).alias("tissue"), F.coalesce("warm", F.lit(0.0)).alias("warm"))


def _share(name: str, value: float, zero: bool) -> None:
    """Refuses what is no share: from 0 if ``zero``, else above it, up to 1."""
    if not (0 <= value <= 1 and (zero or value > 0)):
        raise ValueError(f"{name} must be {'from 0' if zero else 'above 0, up'} to 1, not {value}")


_BOX = pa.struct([(s, pa.int32()) for s in boxes.SIDES])


def _box(found) -> dict | None:
    return None if found is None else dict(zip(boxes.SIDES, found, strict=True))


def _grid(rows: pa.Table, column: str, height: int, width: int) -> np.ndarray:
    out = np.zeros((height, width), dtype=np.uint8)
    out[rows.column("y").to_numpy(), rows.column("x").to_numpy()] = rows.column(column).to_numpy(zero_copy_only=False).astype(np.uint8)
    return out


def clean_masks(votes: DataFrame, width: int, height: int, flag: str = "tissue") -> DataFrame:
    """Each recording's stable mask, cleaned, as its pixels that are on: recording_id, y, x."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ys, xs = np.nonzero(kernels.clean(_grid(rows, flag, height, width)))
        return pa.table({"recording_id": pa.array([key[0].as_py()] * len(ys), pa.int64()), "y": pa.array(ys, pa.int32()), "x": pa.array(xs, pa.int32())})

    return votes.select("recording_id", "y", "x", flag).groupBy("recording_id").applyInArrow(run, "recording_id long, y int, x int")


def mixed_sizes(pixels: DataFrame) -> DataFrame:
    """Recordings whose masks differ in size: their pixels cannot vote together."""
    size = pixels.groupBy(*FRAME).agg(F.max("x").alias("w"), F.max("y").alias("h"))
    return size.groupBy("recording_id").agg(F.min("w").alias("w0"), F.max("w").alias("w1"), F.min("h").alias("h0"), F.max("h").alias("h1")).where("w0 < w1 or h0 < h1").select("recording_id")


def crop_choices(
    votes: DataFrame,
    presence: DataFrame,
    width: int,
    height: int,
    aspect: float = fixed.ASPECT,
    min_inner: float | None = None,
    detector: bool = True,
    popup_mask_reliable: bool = False,
    popup_mask_reason: str = "",
) -> DataFrame:
    """Inner and full boxes of each recording with preserved shares and review reasons, or null boxes with the reason.

    ``presence`` has a row for every recording with masks; one without votes has
    none to show. ``popup_mask_reliable`` asserts that the popup masks can be
    trusted, which needs a ``detector``.
    """
    if popup_mask_reliable and not detector:
        raise ValueError("popup masks cannot be reliable without a class for popups")
    if min_inner is not None:
        _share("min_inner", min_inner, True)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tissue, view = (kernels.clean(_grid(rows, c, height, width)) for c in ("tissue", "view"))
        inner = full = None
        shares, reason = [0.0] * 4, fixed.OK
        if not tissue.any():
            reason = "no stable tissue"
        elif not view.any():
            reason = "no stable view"
        elif (inner := kernels.inscribed(tissue, aspect)) is None:
            reason = "no inner rectangle"
        else:
            ys, xs = np.nonzero(view)
            full = (int(xs.min()), int(ys.min()), int(xs.max()) + 1, max(int(ys.max()) + 1, inner[3]))
            shares = [float(m[b[1] : b[3], b[0] : b[2]].sum() / m.sum()) for m in (tissue, view) for b in (inner, full)]
        return pa.table(
            {"recording_id": pa.array([key[0].as_py()], pa.int64()), "inner_box": pa.array([_box(inner)], _BOX), "full_box": pa.array([_box(full)], _BOX)}
            | {n: pa.array([v], pa.float64()) for n, v in zip(("inner_tissue", "full_tissue", "inner_view", "full_view"), shares, strict=True)}
            | {"reason": pa.array([reason], pa.string())}
        )

    schema = f"recording_id long, inner_box {boxes.BOX}, full_box {boxes.BOX}, inner_tissue double, full_tissue double, inner_view double, full_view double, reason string"
    found = votes.select("recording_id", "y", "x", "tissue", "view").groupBy("recording_id").applyInArrow(run, schema)
    found = presence.select("recording_id", "popup_frames", "popup_share", "popup_present").join(found, "recording_id", "full")
    found = found.withColumn("reason", F.coalesce("reason", F.lit("no masks")))
    trusted = popup_mask_reason or ("" if popup_mask_reliable else "raw masks: no popup footprint is asserted")
    found = found.withColumns({"popup_mask_reliable": F.lit(popup_mask_reliable), "popup_mask_reason": F.lit(trusted)})
    if min_inner is None:
        review = F.array().cast("array<string>")
    else:
        low = F.when(F.col("popup_present") & (F.col("inner_tissue") < min_inner), F.format_string(f"popup present, inner box keeps %.4f, below {min_inner:.4f}", "inner_tissue"))
        blind = F.lit(None if detector else "a least inner share is set, but popups cannot be seen").cast("string")
        review = F.array_compact(F.array(low, blind))
    return found.withColumn("review_reasons", review).withColumn("review_required", F.size("review_reasons") > 0)


def popup_boxes(frames: DataFrame, min_area: int = fixed.MIN_COMPONENT, min_rim: int = fixed.MIN_RIM) -> DataFrame:
    """Frames (width, height, pixels, labels) with their repaired popup mask and candidate box; frame by frame, no shuffle."""

    def run(batches):
        for batch in batches:
            out = []
            for w, h, p, m in zip(*(batch.column(n).to_pylist() for n in ("width", "height", "pixels", "labels")), strict=True):
                frame, mask = np.frombuffer(p, np.uint8).reshape(h, w, 3), np.frombuffer(m, np.uint8).reshape(h, w)
                repaired, footprint, repairs, main = kernels.popup_repair(frame, mask, min_area, min_rim)
                out.append((repaired.tobytes(), len(repairs), sum(r["added_pixels"] for r in repairs), main, _box(kernels.popup_box(footprint, repaired))))
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), _BOX)
            yield pa.RecordBatch.from_arrays([batch.column("recording_id"), batch.column("frame_index"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], [*FRAME, "labels", "n_repairs", "added_pixels", "main_area", "box"])

    return frames.selectExpr(*_LONG, "width", "height", "pixels", "labels").mapInArrow(run, f"recording_id long, frame_index long, labels binary, n_repairs int, added_pixels long, main_area long, box {boxes.BOX}")


def packed(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Pixel rows as frames with binary pixels and labels; a frame is one bounded group."""
    at = F.struct("y", "x", *(F.lpad(F.hex(c), 2, "0").alias(c) for c in ("b", "g", "r", "cls")))
    rows = pixels.groupBy(*FRAME).agg(F.array_sort(F.collect_list(at)).alias("p"))
    colour = F.unhex(F.concat_ws("", F.transform("p", lambda q: F.concat(q["b"], q["g"], q["r"]))))
    return rows.select(*FRAME, F.lit(width).alias("width"), F.lit(height).alias("height"), colour.alias("pixels"), F.unhex(F.concat_ws("", F.transform("p", lambda q: q["cls"]))).alias("labels"))


def unpacked(frames: DataFrame) -> DataFrame:
    """Frames of any sizes (width, height, pixels, labels) as pixel rows, the inverse of ``packed``; no shuffle.

    Gray is 0.299 R + 0.587 G + 0.114 B, rounded.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                w, n = row["width"], row["width"] * row["height"]
                colour = np.frombuffer(row["pixels"], np.uint8).reshape(n, 3)
                gray = np.rint(colour @ np.array([0.114, 0.587, 0.299]))
                # a slice of rows at a time, so that a batch is bounded whatever the frame's size
                for a in range(0, n, 1 << 16):
                    at = np.arange(a, min(a + (1 << 16), n))
                    values = (at // w, at % w, np.frombuffer(row["labels"], np.uint8)[at], gray[at], *colour[at].T)
                    own = [pa.array(np.full(len(at), row[c]), pa.int64()) for c in FRAME]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(v.astype(np.int32)) for v in values)], [*FRAME, "y", "x", "cls", "gray", "b", "g", "r"])

    return frames.selectExpr(*_LONG, "width", "height", "pixels", "labels").mapInArrow(run, "recording_id long, frame_index long, y int, x int, cls int, gray int, b int, g int, r int")
