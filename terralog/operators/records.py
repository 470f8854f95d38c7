"""Identity, redaction and admission of records: digests, credential scrubbing, URL policy, names."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Key fragments (compared lower-case, letters and digits only, so spellings with underscores are equal), geometry keys, path patterns.
CREDENTIAL_FRAGMENTS = ("token", "secret", "credential", "password", "apikey", "authorization", "cookie", "privatekey")
GEOMETRY_KEYS = ("geometry", "coordinates", "features", "geom", "raster")
PATH_PLACEHOLDER = "<path>"
POSIX_PATH = r"^/[^\s/]+(?:/[^\s/]+)+/?$"
WINDOWS_PATH = r"^[A-Za-z]:[\\/][^\s]+(?:[\\/][^\s]+)*$"
MAX_ITEMS = 32
MAX_URL_LENGTH = 2048

# Drawable geometry types.
DRAWABLE = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")

# Our keyword table for layer names, by priority; Latin words match whole words only.
SEMANTIC_KEYWORDS = (
    ("facility", ("hospital", "clinic", "school", "library", "facility", "医院", "学校")),
    ("transit", ("bus", "metro", "subway", "station", "rail", "地铁", "公交")),
    ("water", ("river", "rivers", "lake", "water", "河", "湖")),
    ("boundary", ("boundary", "border", "district", "边界")),
    ("road", ("road", "street", "highway", "道路")),
)


def canonical_digest(cols: dict[str, Column]) -> Column:
    """SHA-256 of a value whose keys are ordered by name, so key order never matters."""
    ordered = [cols[k].alias(k) for k in sorted(cols)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def feature_ref(cols: dict[str, Column]) -> Column:
    """Stable id of a feature inside one version."""
    return F.concat(F.lit("f-"), F.substring(canonical_digest(cols), 1, 16))


def import_fingerprint(fmt: Column, source_digest: Column, encoding: Column, crs: Column, candidates: Column) -> Column:
    return canonical_digest({"format": fmt, "sourceDigest": source_digest, "encoding": encoding,
                             "nativeCrs": crs, "candidates": candidates})


def is_credential_key(key: Column) -> Column:
    folded = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    return folded.rlike("|".join(CREDENTIAL_FRAGMENTS))


def is_path(value: Column) -> Column:
    return value.rlike(POSIX_PATH) | value.rlike(WINDOWS_PATH)


def _marker(key: Column, value: Column) -> Column:
    return (F.when(is_credential_key(key), "credential").when(F.lower(key).isin(*GEOMETRY_KEYS) & value.rlike(r"^[\[{]"), "geometry")
            .when(is_path(value), "path"))


def sanitize_map(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Redact a ``map<string,string>``; ``redactions`` lists what was taken out, in key order."""
    def clean(k, v):
        kind = _marker(k, v)
        return (F.when(kind == "credential", F.concat(F.lit("[redacted:"), k, F.lit("]")))
                .when(kind == "geometry", F.lit('{"obsRedacted":"geometry"}'))
                .when(kind == "path", F.lit(PATH_PLACEHOLDER)).otherwise(v))
    keys = F.array_sort(F.map_keys(fields))
    notes = F.filter(F.transform(keys, lambda k: F.concat_ws(":", _marker(k, F.col(fields)[k]), k)), lambda s: s.contains(":"))
    return df.withColumn("redactions", notes).withColumn(fields, F.transform_values(fields, clean))


def sanitize_items(items: Column) -> Column:
    """First ``MAX_ITEMS`` entries of a list, paths hidden."""
    return F.transform(F.slice(items, 1, MAX_ITEMS), lambda v: F.when(is_path(v), PATH_PLACEHOLDER).otherwise(v))


class _Redaction:
    """One JSON value cleaned in place, with an explicit stack; ``notes`` says what was taken out, in document order."""

    def __init__(self, max_depth: int, max_items: int):
        self.paths = re.compile(f"(?:{POSIX_PATH})|(?:{WINDOWS_PATH})")
        self.max_depth, self.max_items = max_depth, max_items

    def _instead(self, value, name: str, label: str, depth: int):
        """(note, replacement) of a value that may not stay, else None."""
        container = isinstance(value, dict | list)
        if container and depth >= self.max_depth:
            return f"depth:{label}", "[truncated:depth]"
        if container and name.lower() in GEOMETRY_KEYS:
            return f"geometry:{name}", {"obsRedacted": "geometry"}
        if isinstance(value, str) and self.paths.match(value):
            return f"path:{label}", PATH_PLACEHOLDER
        return None

    def clean(self, text: str) -> tuple[str | None, list[str]]:
        try:
            box = [json.loads(text)]
        except ValueError:
            return None, ["unreadable:<root>"]
        notes: list[str] = []
        todo = [(box, 0, "", 0)]
        while todo:
            holder, slot, name, depth = todo.pop()
            if isinstance(holder, dict) and any(f in re.sub("[^a-z0-9]", "", name.lower()) for f in CREDENTIAL_FRAGMENTS):
                notes.append(f"credential:{name}")
                holder[slot] = f"[redacted:{name}]"
                continue
            value = holder[slot]
            if taken := self._instead(value, name, name or "<root>", depth):
                notes.append(taken[0])
                holder[slot] = taken[1]
            elif isinstance(value, dict):
                todo += [(value, k, k, depth + 1) for k in reversed(value)]
            elif isinstance(value, list):
                if len(value) > self.max_items:
                    notes.append(f"items:{name or '<root>'}")
                    del value[self.max_items:]
                todo += [(value, i, f"{name}[{i}]" if name else str(i), depth + 1) for i in reversed(range(len(value)))]
        return json.dumps(box[0], ensure_ascii=False), notes


def sanitize_json(df: DataFrame, payload: str, max_depth: int = 6, max_items: int = MAX_ITEMS) -> DataFrame:
    """Redact arbitrarily nested JSON; nesting of unknown shape is walked in Arrow batches.

    A text that is no JSON becomes null with the note ``unreadable``; a null stays null.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("redactions", T.ArrayType(T.StringType()))])

    def batches(frames):
        redaction = _Redaction(max_depth, max_items)
        for pdf in frames:
            done = [(None, []) if raw is None else redaction.clean(raw) for raw in pdf[payload]]
            yield pdf.assign(**{payload: [d[0] for d in done], "redactions": [d[1] for d in done]})
    return df.mapInPandas(batches, schema)


def display_supported(geom_type: Column) -> Column:
    return F.coalesce(geom_type.isin(*DRAWABLE), F.lit(False))


def infer_semantic(name: Column) -> Column:
    """First class (by priority) with a keyword in the name; Latin keywords match whole words."""
    out = None
    for label, words in SEMANTIC_KEYWORDS:
        latin = [w for w in words if w.isascii()]
        other = [w for w in words if not w.isascii()]
        hit = F.lower(name).rlike(r"\b(" + "|".join(latin) + r")\b")
        for w in other:
            hit = hit | name.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def url_policy(url: Column) -> Column:
    """``ok`` or the refusal: too-long, invalid, scheme, credentials."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(authority, r"^.*@", "")
    user_info = F.regexp_extract(authority, r"^(.*)@", 1)
    return (F.when(F.char_length(url) > MAX_URL_LENGTH, "too-long")
            .when(scheme == "", "invalid")
            .when(~scheme.isin("http", "https"), "scheme")
            .when(host == "", "invalid")
            .when(F.length(F.regexp_replace(user_info, ":", "")) > 0, "credentials").otherwise("ok"))
