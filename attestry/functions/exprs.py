"""Scalar expressions over record fields, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT = "\n... [truncated]"


def stable_id(file: Column, module: Column, name: Column, line: Column, kind: Column, sub: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", file, module, name, line.cast("string"), kind, sub), 256), 1, 20)


def module_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/", ".")


def qualified_name(module: Column, cls: Column, method: Column) -> Column:
    some = lambda c: F.when(c != "", c)
    return F.concat_ws(".", module, some(cls), some(method))


def raw_slice(text: Column, start: Column, end: Column, most: int = 5000) -> Column:
    """Lines start..end (from 1), cut at ``most`` characters with a mark."""
    first = F.greatest(start, F.lit(1))
    part = F.array_join(F.slice(F.split(text, "\n", -1), first, F.greatest(end - first + 1, F.lit(0))), "\n")
    return F.when(F.length(part) > most, F.concat(F.substring(part, 1, most), F.lit(CUT))).otherwise(part)


def module_top(module: Column, parts: int = 2) -> Column:
    return F.substring_index(module, ".", parts)


def heat_module(module: Column, path: Column) -> Column:
    return F.when(module != "", F.substring_index(module, ".", 1)).otherwise(F.substring_index(path, "/", 1))


def short_path(path: Column) -> Column:
    return F.substring_index(path, "/", -2)


def tag_uri(tag: Column, base: str = "https://example.org/legal") -> Column:
    number = F.substring_index(tag, "_art_", -1)
    return F.when(tag.startswith("eu_ai_act_art_"), F.concat(F.lit(f"{base}/eu-ai-act/Art"), number)).when(tag.startswith("gdpr_art_"), F.concat(F.lit(f"{base}/gdpr/Art"), number))


def tag_label(tag: Column) -> Column:
    frame = F.upper(F.replace(F.substring_index(tag, "_art_", 1), F.lit("_"), F.lit(" ")))
    return F.concat(frame, F.lit(" Art."), F.substring_index(tag, "_art_", -1))


def article_of(obligation: Column) -> Column:
    found = F.regexp_extract(obligation, r"^(Art[0-9]+)", 1)
    return F.when(found != "", found).otherwise("Unknown")


def safe_name(name: Column) -> Column:
    """Control characters out, other than letters, digits, ``. _ -`` as ``_``, at most 128, never empty."""
    n = F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1f\x7f]", ""), r"[^a-zA-Z0-9._-]", "_")
    return F.when(n == "", "_empty_").otherwise(F.substring(n, 1, 128))


def safe_log(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").when(c >= 0.4, "low").otherwise("speculative")


def clamp(c: Column, default: float) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.try_cast("double"))), F.lit(default))


def tensor_hash(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 16)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once, where a lambda would make it anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(logits: Column) -> Column:
    exps = lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return let(let(F.array_max(logits), exps), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def argmax(values: Column) -> Column:
    """Index from 0 of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def entropy(p: Column) -> Column:
    floor = lambda x: F.greatest(x, F.lit(1e-9))
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + floor(x) * F.ln(floor(x)))


def top_mass(p: Column, k: int = 3) -> Column:
    return F.aggregate(F.slice(F.sort_array(p, asc=False), 1, k), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v / |v|; a zero vector stays zero."""
    return let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def embed_text(name: Column, doc: Column) -> Column:
    return F.when(doc != "", F.concat(name, F.lit(": "), F.substring(doc, 1, 200))).otherwise(name)


def triplets(text: Column) -> Column:
    """Structs (subject, object, relation) of ``<triplet> s <subj> o <obj> r`` runs."""
    form = r"<triplet>\s*([^<]*?)\s*<subj>\s*([^<]*?)\s*<obj>\s*([^<]*?)\s*(?=<|$)"
    part = lambda k: F.regexp_extract_all(text, F.lit(form), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("s"), part(2).alias("o"), part(3).alias("r")), lambda x: F.struct(x["s"].alias("subject"), x["o"].alias("object"), x["r"].alias("relation")))


def hook_phase(name: Column) -> Column:
    has = lambda *w: _any(name, w)
    return F.when(has("forward"), "forward").when(has("backward", "grad"), "backward").when(has("state_dict", "load"), "serialization").when(has("train", "eval"), "mode").when(has("profile", "record", "trace"), "profiling").when(has("dispatch"), "dispatch").otherwise("runtime")


def _any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def cell(value: Column, most: int = 40) -> Column:
    v = F.when(value.contains("#"), F.substring_index(value, "#", -1)).when(value.startswith("http"), F.substring_index(value, "/", -1)).otherwise(value)
    return F.substring(v, 1, most)


def line_of(before: Column) -> Column:
    """Line number of a place from the text that stands before it."""
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def dependency(line: Column) -> Column:
    return F.trim(F.element_at(F.split(line, r"[>=<!\[]"), 1))


def json_salvage(answer: Column) -> Column:
    """Thinking out; the widest ``[...]``, else the widest ``{...}``, else empty."""
    t = F.regexp_replace(answer, r"(?s)<think>.*?</think>", "")
    arr, obj = F.regexp_extract(t, r"(?s)\[.*\]", 0), F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(arr != "", arr).otherwise(obj)


def pack_paragraphs(text: Column, most: int = 2000, by: str = "\n\n") -> Column:
    """Paragraphs packed while they fit in ``most`` characters; a text that fits stays as it is."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(a, p):
        fits = F.length(a["cur"]) + F.length(p) + 2 <= most
        closed = F.when(F.trim(a["cur"]) != "", F.array_append(a["done"], F.trim(a["cur"]))).otherwise(a["done"])
        joined = F.when(a["cur"] != "", F.concat(a["cur"], F.lit(by), p)).otherwise(p)
        return F.struct(F.when(fits, a["done"]).otherwise(closed).alias("done"), F.when(fits, joined).otherwise(p).alias("cur"))

    packed = F.aggregate(F.split(text, by, -1), start, add, lambda a: F.when(F.trim(a["cur"]) != "", F.array_append(a["done"], F.trim(a["cur"]))).otherwise(a["done"]))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)


def populated(names_types: dict[str, str]) -> Column:
    """How many fields hold something: non-empty strings, arrays and maps, numbers other than zero."""
    total = F.lit(0)
    for n, kind in names_types.items():
        c = F.col(n)
        full = F.size(c) > 0 if kind in ("array", "map") else c != 0 if kind == "number" else c != ""
        total = total + F.when(full, 1).otherwise(0)
    return total


def kl(base_mean: Column, base_var: Column, mean: Column, var: Column) -> Column:
    """Divergence of the normal base from the normal current, one dimension."""
    return 0.5 * (base_var / var + (mean - base_mean) ** 2 / var - 1 + F.ln(var) - F.ln(base_var))
