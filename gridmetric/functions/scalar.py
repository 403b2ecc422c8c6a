"""Column functions: scores, labels, bins, coordinates and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Scores and labels


def threshold_probability(p, t: float, comparison: str = "greater_than", as_float: bool = False) -> Column:
    """1 where p passes t; NaN never does. as_float: the threshold in single precision, as float scores need it."""
    p, cut = _c(p), F.lit(t).cast("float") if as_float else F.lit(float(t))
    if comparison not in ("greater_than", "greater_equal"):
        raise ValueError(f"unknown comparison {comparison!r}")
    return F.when(~F.isnan(p) & ((p > cut) if comparison == "greater_than" else (p >= cut)), 1).otherwise(0)


def binarise(reference, water=(1,)) -> Column:
    return F.when(_c(reference).isin(*water), 1).otherwise(0)


def standardise(x, mean: float, std: float) -> Column:
    return (_c(x) - mean) / std


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def softmax_share(logits: list, k: int) -> Column:
    """Share of class k under softmax, with the largest logit taken off first."""
    top = F.greatest(*map(_c, logits))
    return F.exp(_c(logits[k]) - top) / reduce(lambda a, b: a + b, [F.exp(_c(x) - top) for x in logits])


def water_probability(logits: list) -> Column:
    """One class: sigmoid; more: softmax of class 1."""
    return sigmoid(logits[0]) if len(logits) == 1 else softmax_share(logits, 1)


def confusion_code(y, predicted, valid=None) -> Column:
    """1 TP, 2 FP, 3 FN, 4 TN, 0 where not valid."""
    y, q = _c(y), _c(predicted)
    code = F.when((y == 1) & (q == 1), 1).when(q == 1, 2).when(y == 1, 3).otherwise(4)
    return code if valid is None else F.when(_c(valid), code).otherwise(0)


def decode_confusion(code) -> dict[str, Column]:
    code = _c(code)
    return {"predicted": code.isin(1, 2).cast("int"), "reference": code.isin(1, 3).cast("int"), "error": code.isin(2, 3).cast("int")}


def argmax_class(scores) -> Column:
    """Number of the largest entry, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)) - 1


def finite(*xs) -> Column:
    """No argument is null, NaN or infinite."""
    return reduce(lambda a, b: a & b, [_c(x).isNotNull() & ~F.isnan(_c(x)) & (F.abs(_c(x)) < float("inf")) for x in xs])


def finite_or_zero(x) -> Column:
    return F.when(finite(x), _c(x)).otherwise(0.0)


def safe_div(n, d, zero: float | None = 0.0) -> Column:
    out = F.try_divide(_c(n).cast("double"), _c(d).cast("double"))
    return out if zero is None else F.coalesce(out, F.lit(zero))


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(_c(a) - _c(b)) <= atol + rtol * F.abs(_c(b))


# Bins


def fine_bin(p, bins: int) -> Column:
    """Score clipped to 0-1, then floor(p * bins), the last bin closed."""
    return F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(p))) * bins), F.lit(bins - 1)).cast("int")


def linspace(start: float, stop: float, n: int) -> list[float]:
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [stop]


def edge_bin(p, edges: list[float]) -> Column:
    """Right-open bins by their edges, the last closed; null outside."""
    p, e = _c(p), F.array(*map(F.lit, edges))
    at = F.size(F.filter(e, lambda x: p >= x)) - 1
    return F.when((p < edges[0]) | (p > edges[-1]) | F.isnan(p), None).when(p == edges[-1], len(edges) - 2).otherwise(at)


def threshold_grid(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... up to stop, rounded to ten digits."""
    if step <= 0:
        raise ValueError("step must be positive")
    if stop < start:
        raise ValueError("stop must not be below start")
    n = int((stop - start) / step + 1e-9)
    return [round(start + i * step, 10) for i in range(n + 1)]


def percentile_stretch(x, low, high) -> Column:
    """x between two percentiles as 0-1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(_c(x) - _c(low), _c(high) - _c(low))))


# Coordinates


def pixel_to_map(row, col, a, b, c, d, e, f) -> tuple[Column, Column]:
    """Map coordinates of a pixel's centre under an affine transform."""
    r, k = _c(row) + 0.5, _c(col) + 0.5
    return _c(a) * k + _c(b) * r + _c(c), _c(d) * k + _c(e) * r + _c(f)


def meters_per_degree(latitude) -> tuple[Column, Column]:
    """Metres per degree of longitude and of latitude, by the usual series."""
    x = F.radians(_c(latitude))
    # Coefficients of the series.
    lat = 111_132.92 - 559.82 * F.cos(2 * x) + 1.175 * F.cos(4 * x)
    lon = 111_412.84 * F.cos(x) - 93.5 * F.cos(3 * x)
    return F.abs(lon), F.abs(lat)


# Identifiers

#: Patterns of scene ids.
S1_ID, S2_ID = r"(S1_\d{8}_\d{6}_\d+_\d+_\d+)", r"(S2_\d{8}_\d{6})"


def extract_id(name, pattern: str) -> Column:
    """First group of the pattern, null without a match."""
    return F.nullif(F.regexp_extract(_c(name), pattern, 1), F.lit(""))


def sanitize_for_path(x) -> Column:
    s = F.regexp_replace(F.trim(_c(x)), r"\.", "p")
    s = F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9_-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def infer_inference_mode(name) -> Column:
    low = F.lower(_c(name))
    return F.when(low.contains("large_crop_only"), "large_crop_only").when(low.contains("native224"), "native224").when(low.contains("whole"), "whole").otherwise("")


def fill_template(template: str, **values) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), _c(value))
    return out


def scene_date(scene_id) -> Column:
    """yyyy-mm-dd of an id's second part, or the id itself."""
    part = F.try_element_at(F.split(_c(scene_id), "_"), F.lit(2))
    return F.when(F.length(part) == 8, F.concat_ws("-", F.substring(part, 1, 4), F.substring(part, 5, 2), F.substring(part, 7, 2))).otherwise(_c(scene_id))


def strip_run_timestamp(x) -> Column:
    return F.regexp_replace(_c(x), r"__\d{8}T\d{6}Z$", "")


def strip_suffix(x, suffixes: list[str]) -> Column:
    """x without the first of the suffixes that ends it."""
    x = _c(x)
    out = None
    for s in suffixes:
        cut = F.substring(x, F.lit(1), F.length(x) - len(s))
        out = F.when(x.endswith(s), cut) if out is None else out.when(x.endswith(s), cut)
    return out.otherwise(x)


def first_suffix(x, names: dict[str, str]) -> Column:
    """Name of the first suffix that ends x, else null."""
    out = None
    for suffix, name in names.items():
        out = F.when(_c(x).endswith(suffix), name) if out is None else out.when(_c(x).endswith(suffix), name)
    return out


def format_count(n) -> Column:
    """1348463 as 1.3M, 190495 as 190k."""
    n = _c(n)
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.0f", n / 1000), F.lit("k"))).otherwise(n.cast("string"))


def format_signed(x) -> Column:
    return F.format_string("%+.3f", _c(x))


def format_interval(low, high, digits: int = 4) -> Column:
    return F.format_string(f"[%.{digits}f, %.{digits}f]", _c(low), _c(high))


def checkpoint_id(stem, arch, encoder) -> Column:
    """The stem, with architecture and encoder before a generic one."""
    s = sanitize_for_path(stem)
    return F.when(s.isin("best_model", "model", "checkpoint", "unknown"), F.concat(sanitize_for_path(arch), F.lit("-"), sanitize_for_path(encoder), F.lit("_"), s)).otherwise(s)


def prediction_type(x) -> Column:
    """Canonical name of a prediction type; an unknown one is an error when evaluated."""
    low = F.lower(F.coalesce(_c(x), F.lit("probability_map")))
    return F.when(low.isin("probability", "probability_map", "prob_map"), "probability_map").otherwise(F.raise_error(F.concat(F.lit("unsupported prediction type "), low)).cast("string"))


def model_name(x) -> Column:
    return F.translate(_c(x), " ", "_")


def return_code(x) -> Column:
    """Whole number of a return code; null for what isn't one."""
    return F.expr(f"try_cast(nullif(trim({x}), '') AS INT)") if isinstance(x, str) else x.try_cast("int")


def cli_value(x, kind: str) -> Column:
    """bool as true/false, array as [a,b], else text."""
    if kind == "array":
        return F.concat(F.lit("["), F.array_join(_c(x), ","), F.lit("]"))
    return _c(x).cast("string")


def run_reference(ref, project: str) -> Column:
    """entity/project/run of a run's url, path or bare id."""
    ref = F.trim(_c(ref))
    parts = F.split(F.regexp_replace(F.regexp_replace(ref, r"\?.*$", ""), "/+$", ""), "/")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return F.when(ref.startswith("http"), F.concat_ws("/", at(-4), at(-3), at(-1))).when(ref.contains("/"), ref).otherwise(F.concat(F.lit(project + "/"), ref))


def drop_private(m) -> Column:
    """A map without keys that begin with an underscore."""
    return F.map_filter(m, lambda k, _: ~k.startswith("_"))


def timestamp_id(ts) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd'T'HHmmss'Z'")


def utc_iso(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
