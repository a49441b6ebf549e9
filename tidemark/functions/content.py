"""Functions of an object's bytes, of JSON documents and of report cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature(content: Column) -> Column:
    """STRUCT<hash, size>: SHA-256 in hex and the number of bytes."""
    raw = content.cast("binary")
    return F.struct(F.sha2(raw, 256).alias("hash"), F.octet_length(raw).cast("long").alias("size"))


def sig_equal(a: Column, b: Column) -> Column:
    """Equal hashes; where either is empty, equal sizes."""
    both = (F.coalesce(a["hash"], F.lit("")) != "") & (F.coalesce(b["hash"], F.lit("")) != "")
    return F.when(both, a["hash"] == b["hash"]).otherwise(a["size"] == b["size"])


def digests(content: Column) -> Column:
    """STRUCT<md5, sha256, crc32> of an object's bytes."""
    raw = content.cast("binary")
    return F.struct(F.md5(raw).alias("md5"), F.sha2(raw, 256).alias("sha256"), F.crc32(raw).alias("crc32"))


def decode_jsonapi(df: DataFrame, content: str = "content") -> DataFrame:
    """The rows of `df` (without the document) for each resource of its document, with pos, id, type and attributes VARIANT.

    `data` may be an object, a list or null; a document that isn't JSON has no resources.
    """
    doc = F.try_parse_json(F.col(content).cast("string"))
    data = F.try_variant_get(doc, "$.data", "variant")
    is_list = F.startswith(F.schema_of_variant(data), F.lit("ARRAY"))
    is_object = F.startswith(F.schema_of_variant(data), F.lit("OBJECT"))
    items = F.when(is_list, F.try_variant_get(data, "$", "array<variant>")).when(is_object, F.array(data))
    rest = [c for c in df.columns if c != content]
    rows = df.select(*rest, F.posexplode(items).alias("pos", "resource"))
    get = lambda key, kind: F.try_variant_get(F.col("resource"), key, kind)
    return rows.select(*rest, "pos", get("$.id", "string").alias("id"), get("$.type", "string").alias("type"), get("$.attributes", "variant").alias("attributes"))


def _attr(attributes: Column, key: str) -> Column:
    return F.try_variant_get(attributes, f"$['{key}']", "variant")


def attr_string(attributes: Column, key: str) -> Column:
    """The attribute if it is a string, else ''."""
    v = _attr(attributes, key)
    return F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string")).otherwise("")


def attr_bool(attributes: Column, key: str) -> Column:
    """The attribute if it is a boolean, else false."""
    v = _attr(attributes, key)
    return F.when(F.schema_of_variant(v) == "BOOLEAN", v.try_cast("boolean")).otherwise(False)


def attr_int(attributes: Column, key: str) -> Column:
    """The attribute if it is a number, cut to an integer through a double, else 0."""
    v = _attr(attributes, key)
    number = F.schema_of_variant(v).rlike(r"\A(?:BIGINT|DOUBLE|DECIMAL)")
    return F.when(number, v.try_cast("double").cast("long")).otherwise(0)


def attr_bool_ok(attributes: Column, key: str) -> Column:
    """The attribute if it is a boolean, else null."""
    v = _attr(attributes, key)
    return F.when(F.schema_of_variant(v) == "BOOLEAN", v.try_cast("boolean"))


def attr_int_ok(attributes: Column, key: str) -> Column:
    """The attribute if it is a number, cut to an integer through a double, else null."""
    v = _attr(attributes, key)
    return F.when(F.schema_of_variant(v).rlike(r"\A(?:BIGINT|DOUBLE|DECIMAL)"), v.try_cast("double").cast("long"))


def attr_time(attributes: Column, key: str) -> Column:
    """The attribute if it is a string that holds a time, else null."""
    text = attr_string(attributes, key)
    return F.when(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T"), F.try_to_timestamp(text))


def redact_variable(sensitive: Column, value: Column) -> Column:
    """A variable's value, unless it is sensitive."""
    return F.when(F.coalesce(sensitive, F.lit(False)), F.lit("(sensitive)")).otherwise(F.coalesce(value, F.lit("")))


def fmt_time(at: Column) -> Column:
    """A time as a report cell, to the minute; '' if unknown."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(""))


def bool_cell(value: Column) -> Column:
    """`true` or `false`; '' if unknown."""
    return F.coalesce(value.cast("string"), F.lit(""))


def human_bytes(n: Column) -> Column:
    """Bytes in binary units to one place, halves to the even digit; what would round up to 1024 of a unit becomes 1 of the next."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    units = ["KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
    for i, unit in enumerate(units):
        value = n / F.lit(float(1024 ** (i + 1)))
        from_here = n >= 1024 if i == 0 else F.bround(n / F.lit(float(1024**i)), 1) >= 1024
        out = F.when(from_here, F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def count_noun(n: Column, singular: str, plural: str) -> Column:
    """`1 run`, `2 runs`."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, singular).otherwise(plural))


def first_line(text: Column) -> Column:
    """Up to the first line end, without white space around it."""
    return F.trim(F.substring_index(text, "\n", 1))


def display_form(form: Column, offloaded: Column) -> Column:
    """An object's form, marked where its bytes are only in the mirror."""
    return F.concat(form, F.when(offloaded, " (offloaded)").otherwise(""))


def semver_key(version: Column) -> Column:
    """STRUCT that sorts by semantic-version precedence, or null if unparseable: numbers, then release over prerelease, then identifiers.

    A version has any number of numbers, and zeros at the end don't count; one
    beyond 64 bits makes it unparseable. Numeric identifiers sort as numbers and
    before others, those beyond 64 bits as words; build metadata doesn't count.
    """
    m = r"\Av?(\d+(?:\.\d+)*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\z"
    numbers = F.transform(F.split(F.regexp_extract(version, m, 1), r"\."), lambda x: x.try_cast("long"))
    # The last number that isn't 0 ends the array, so that 1.2 and 1.2.0 are one.
    used = F.array_max(F.transform(numbers, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    pre = F.regexp_extract(version, m, 2)
    number = lambda x: F.when(x.rlike(r"\A\d+\z"), x.try_cast("bigint"))
    idents = F.when(pre == "", F.array().cast("array<struct<word:boolean,number:bigint,text:string>>")).otherwise(
        F.transform(F.split(pre, r"\."), lambda x: F.struct(number(x).isNull().alias("word"), F.coalesce(number(x), F.lit(0).cast("bigint")).alias("number"), F.when(number(x).isNull(), x).otherwise("").alias("text")))
    )
    whole = version.rlike(m) & ~F.exists(numbers, lambda x: x.isNull())
    return F.when(whole, F.struct(F.slice(numbers, F.lit(1), used).alias("numbers"), (pre == "").alias("release"), idents.alias("idents")))


def is_prerelease(version: Column) -> Column:
    """A parseable version with a prerelease part."""
    return F.coalesce(~semver_key(version)["release"], F.lit(False))


def split_relations(df: DataFrame, relation: str, resource: str = "resource") -> tuple[DataFrame, DataFrame]:
    """Two tables from a VARIANT `resource` that carries a hydrated relation: parents with the child's id, and the children."""
    at = f"$.relationships['{relation}'].data"
    get = lambda key, kind: F.try_variant_get(F.col(resource), key, kind)
    rest = [c for c in df.columns if c != resource]
    parents = df.select(*rest, get("$.id", "string").alias("id"), get("$.type", "string").alias("type"), get("$.attributes", "variant").alias("attributes"), get(f"{at}.id", "string").alias("relation_id"))
    children = df.select(get(f"{at}.id", "string").alias("id"), get(f"{at}.type", "string").alias("type"), get(f"{at}.attributes", "variant").alias("attributes")).filter("attributes IS NOT NULL")
    return parents, children
