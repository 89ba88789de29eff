"""Path-valued fields and links: URL, bundle path, escape or malformed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ids
from .values import let, strip

#: An absolute URI by its characters; per cent signs need two hexadecimal digits.
URI = r"^([A-Za-z][A-Za-z0-9+.-]*):(?:[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=-]|%[0-9A-Fa-f]{2})*$"
#: A name and the .. after it.
_NAME_UP = r"(?<![^/])(?!\.{1,2}/)[^/]+/\.\./"


def uri_scheme(x: Column) -> Column:
    """The lower-cased scheme of an absolute URI; NULL for anything else."""
    return F.when(x.contains(":") & x.rlike(URI), F.lower(F.regexp_extract(x, URI, 1)))


def without_suffix(x: Column) -> Column:
    """Without a fragment or query."""
    return F.substring_index(F.substring_index(x, "#", 1), "?", 1)


def collapse(path: Column) -> Column:
    """``path`` with . and .. folded; NULL if it climbs above the root, '' if nothing is left.

    Segments are gone through one by one only in what is left to fold once names that a .. follows are gone.
    """
    return let(path, lambda p: F.when(_is_folded(p), p).otherwise(let(F.regexp_replace(p, _NAME_UP, ""), lambda q: F.when(_is_folded(q), q).otherwise(_fold(q)))))


def _is_folded(path: Column) -> Column:
    """Surely without empty segments, . and ..; told by bytes."""
    return ~(path.startswith("/") | path.endswith("/") | path.startswith(".") | path.contains("/.") | path.contains("//"))


def _fold(path: Column) -> Column:
    start = F.expr("named_struct('ok', true, 'at', cast(array() as array<string>))")

    def step(acc, s):
        up = s == ".."
        can = F.size(acc["at"]) > 0
        at = (F.when(s.isin("", "."), acc["at"]).when(up & can, F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0))))
              .when(up, acc["at"]).otherwise(F.concat(acc["at"], F.array(s))))
        return F.struct((acc["ok"] & (~up | can)).alias("ok"), at.alias("at"))

    return F.aggregate(F.split(path, "/"), start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["at"], "/")))


def classify(source_path: Column, raw: Column) -> Column:
    """struct<kind, scheme, path> of a value written in the file ``source_path``.

    kind is external (with its scheme), bundle (with the path from the root), escape or
    malformed. A leading slash resolves from the root, anything else from the file's directory.
    """
    def parts(t, scheme, clean):
        candidate = F.when(clean.startswith("/"), F.ltrim(clean, F.lit("/"))).otherwise(F.concat(ids.directory(source_path), F.lit("/"), clean))
        return F.struct(t.alias("t"), scheme.alias("scheme"), clean.alias("clean"), collapse(candidate).alias("path"))

    def kind(x):
        return (F.when((x["t"] == "") | x["t"].isNull(), "malformed").when(x["scheme"].isNotNull(), "external").when(x["clean"] == "", "malformed")
                .when(x["path"].isNull(), "escape").when(x["path"] == "", "malformed").otherwise("bundle"))

    def whole(x):
        return let(kind(x), lambda k: F.struct(k.alias("kind"), F.when(k == "external", x["scheme"]).alias("scheme"), F.when(k == "bundle", x["path"]).alias("path")))

    return let(strip(raw), lambda t: let(without_suffix(t), lambda c: let(parts(t, uri_scheme(t), c), whole)))


def link_target(source_path: Column, url: Column) -> Column:
    """The concept id that a Markdown link names; NULL for external links and whatever isn't a concept's file."""
    web = url.contains(":") & F.lower(url).rlike("^(https?|mailto):")  # most links are told without an expression's matcher
    return F.when(~web, let(classify(source_path, url)["path"], lambda p: F.when(p.endswith(".md"), ids.valid(F.substring(p, F.lit(1), F.length(p) - 3)))))
