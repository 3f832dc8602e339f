"""Forms of text and values: keys, names, answers' validity, limits of degradations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions import scalars as S

#: Words for yes and no, and properties that may hold a feature's id, first to last (fixed values).
YES, NO = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
ID_PROPERTIES = ("PERMANENT_IDENTIFIER", "permanent_identifier", "OID", "OBJECTID", "GLOBALID", "@id")
#: What a segmentation model may call a class (fixed values).
LABEL_TERMS = {
    "water": ("water", "sea", "river", "lake", "waterfall", "swimming pool"),
    "road": ("road", "route", "path", "runway", "dirt track", "highway"),
    "field": ("field", "grass", "farm"),
}
#: LaTeX escapes in the order in which they are made (fixed values).
LATEX = (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"))


def boolean(value: Column, strict: bool = True) -> Column:
    """A word as a boolean, whatever its case and the space around it. Another word is an error when the plan runs, or
    NULL if not strict; NULL stays NULL."""
    word = F.lower(F.trim(value.cast("string")))
    other = F.raise_error(F.concat(F.lit("neither yes nor no: "), word)).cast("boolean") if strict else F.lit(None).cast("boolean")
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False).when(word.isNotNull(), other)


def eligible(probe: Column, reliable: Column) -> Column:
    """Whether a frame can be scored: grounding needs a reliable registration, other probes nothing."""
    return (probe != "grounding") | F.coalesce(F.lower(F.trim(reliable.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def call_key(model: Column, image_sha256: Column, variant: Column, system: Column, prompt: Column, temperature: Column, max_tokens: Column, max_side: Column, schema: Column) -> Column:
    """Key of a call's content: calls that send the same have the same; the no_image variant has no image."""
    image = F.when(variant == "no_image", F.lit("NO_IMAGE")).otherwise(image_sha256)
    return S.request_id(model, image, system, prompt, temperature, max_tokens, max_side, schema)


def prompt(template: Column, **values: Column) -> Column:
    """A template with its {names} filled in; doubled braces stand for themselves."""
    out = F.replace(F.replace(template, F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return F.replace(F.replace(out, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))


def feature_id(properties: Column, geometry: Column, prefix: str) -> Column:
    """The first id that properties (a map) hold and isn't empty, else the beginning of the digest of the geometry's text."""
    held = F.coalesce(*[F.when(F.element_at(properties, k) != "", F.element_at(properties, k)) for k in ID_PROPERTIES])
    return F.concat(F.lit(prefix + ":"), F.coalesce(held, F.concat(F.lit("sha256:"), F.substring(F.sha2(geometry, 256), 1, 24))))


def label_class(label: Column) -> Column:
    """Classes whose terms a model's label contains."""
    met = [F.when(F.greatest(*[F.lower(label).contains(t) for t in terms]), F.lit(c)) for c, terms in LABEL_TERMS.items()]
    return F.array_compact(F.array(*met))


def words_of_list(text: Column) -> Column:
    """The strings of a list written as ['a', "b"]; NULL unless it is one."""
    inside = F.regexp_extract(F.trim(text), r"^\[(.*)\]$", 1)
    found = F.regexp_extract_all(inside, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0))
    return F.when(F.regexp_like(F.trim(text), F.lit(r"^\[.*\]$")), F.transform(found, lambda w: F.substring(w, F.lit(2), F.char_length(w) - 2)))


def variable_name(prefix: str, model: Column) -> Column:
    """Name of a model's environment variable: letters and digits in capitals, all else one underscore."""
    return F.concat(F.lit(prefix), F.trim(F.regexp_replace(F.upper(model), "[^A-Z0-9]+", "_"), F.lit("_")))


def latex(value: Column) -> Column:
    out = value.cast("string")
    for source, escape in LATEX:
        out = F.replace(out, F.lit(source), F.lit(escape))
    return out


def answer_faults(evidence: Column, ranking: Column, grid: int, budget: int) -> Column:
    """What is wrong with an answer's cells, as an array of names: duplicates, cells outside the grid, a ranking of other
    cells than the evidence, more cells than allowed. NULL arrays count as empty."""
    e, r = (F.coalesce(c, F.array().cast("array<string>")) for c in (evidence, ranking))
    inside = F.array(*[F.lit(f"{i},{j}") for i in range(grid) for j in range(grid)])
    repeated = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    outside = lambda a: F.size(F.array_except(a, inside)) > 0
    differ = (F.size(F.array_except(e, r)) > 0) | (F.size(F.array_except(r, e)) > 0)
    faults = [("evidence_repeats", repeated(e)), ("ranking_repeats", repeated(r)), ("outside_grid", outside(e) | outside(r)), ("ranking_differs", differ), ("over_budget", F.size(e) > budget)]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in faults]))


def registration_threshold_m(ground_width_m: Column) -> Column:
    """A quarter of a cell of a 4 x 4 grid; a width that isn't positive is an error when the plan runs."""
    return F.when(ground_width_m > 0, ground_width_m / 16.0).otherwise(F.raise_error(F.lit("ground width must be positive")).cast("double"))


def degradation_limits(q: dict[str, Column]) -> dict[str, Column]:
    """Largest strengths of degradations from quantiles of measures, named measure_percent. Bounds are fixed values."""
    clip = lambda x, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))
    at_least = lambda c, lo: F.greatest(q[c], F.lit(float(lo)))
    return {
        "blur_max": clip(F.sqrt(q["laplacian_variance_95"] / at_least("laplacian_variance_05", 1)) / 2, 1.2, 3.5),
        "haze_max": clip(0.15 + q["dark_channel_mean_95"] - q["dark_channel_mean_25"], 0.18, 0.5),
        "saturation_min": clip(q["saturation_mean_05"] / at_least("saturation_mean_50", 1e-3), 0.3, 0.85),
        "contrast_min": clip(q["contrast_std_05"] / at_least("contrast_std_50", 1e-3), 0.3, 0.85),
        "jpeg_min": F.floor(clip(75 - q["jpeg_blockiness_95"] * 600, 20, 60)).cast("int"),
        "dark_ev": clip(F.log2(at_least("luminance_mean_05", 0.02) / 0.5), -2, -0.4),
        "bright_ev": clip(F.log2(at_least("luminance_mean_95", 0.5) / 0.5), 0.4, 2),
    }
