"""JSON and XML functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from quern.semantics import _c


def _path(keys) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) or str(k).isdigit() else f"['{k}']" for k in keys)


def extract_path_text(j, *keys) -> Column:
    """json #>> path: text of the element, null where there is none."""
    return F.get_json_object(_c(j), _path(keys))


def array_elements(j) -> Column:
    """Elements of a JSON array as JSON text."""
    return F.transform(F.from_json(_c(j), T.ArrayType(T.VariantType())), lambda e: F.to_json(e))


def each_text(j) -> Column:
    """Map of keys to texts of a JSON object."""
    return F.from_json(_c(j), T.MapType(T.StringType(), T.StringType()))


def object_keys(j) -> Column:
    return F.json_object_keys(_c(j))


def array_length(j) -> Column:
    return F.json_array_length(_c(j))


def row_to_json(*cols) -> Column:
    """The row as an object, null fields kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def json_agg(x, *order) -> Column:
    from quern.semantics import array_agg

    return F.to_json(array_agg(x, *order), {"ignoreNullFields": "false"})


def populate_record(j, schema) -> Column:
    return F.from_json(_c(j), schema)


def populate_recordset(j, schema) -> Column:
    """Array of structs; inline() it for rows."""
    return F.from_json(_c(j), T.ArrayType(schema) if isinstance(schema, T.StructType) else f"array<struct<{schema}>>")


def xml_escape(s) -> Column:
    s = _c(s).cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#x0d;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def xmlelement(name: str, attributes: dict | None = None, *content) -> Column:
    """Null attributes are left out; without content the element is empty."""
    attrs = [F.coalesce(F.concat(F.lit(f' {k}="'), F.replace(xml_escape(v), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit("")) for k, v in (attributes or {}).items()]
    head = F.concat(F.lit(f"<{name}"), *attrs)
    if not content:
        return F.concat(head, F.lit("/>"))
    body = F.concat_ws("", *content)
    return F.when(body == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), body, F.lit(f"</{name}>")))


def xmlforest(**fields) -> Column:
    return F.concat_ws("", *(F.when(_c(v).isNotNull(), F.concat(F.lit(f"<{k}>"), xml_escape(v), F.lit(f"</{k}>"))) for k, v in fields.items()))


def xmlcomment(s) -> Column:
    return F.when(F.contains(_c(s), F.lit("--")) | F.endswith(_c(s), F.lit("-")), F.raise_error(F.lit("invalid XML comment")).cast("string")).otherwise(F.concat(F.lit("<!--"), _c(s), F.lit("-->")))


def xmlpi(name: str, text=None) -> Column:
    return F.lit(f"<?{name}?>") if text is None else F.concat(F.lit(f"<?{name} "), F.ltrim(_c(text)), F.lit("?>"))


def xmlroot(x, version: str = "1.0", standalone: str | None = None) -> Column:
    extra = f' standalone="{standalone}"' if standalone else ""
    return F.concat(F.lit(f'<?xml version="{version}"{extra}?>'), _c(x))


def xpath(x, path: str) -> Column:
    return F.xpath(_c(x), F.lit(path))


def xpath_exists(x, path: str) -> Column:
    return F.xpath_boolean(_c(x), F.lit(path))


def is_document(x) -> Column:
    """Well-formed with one root element."""
    return _parses(x, document=True)


def _parses(x, document: bool) -> Column:
    """Whether the text parses. Spark has no such function, so Arrow batches go to Python, each different text once."""
    import xml.parsers.expat

    import pandas as pd

    def ok(text: str) -> bool:
        p = xml.parsers.expat.ParserCreate()
        try:
            head = re.match(r"\s*<\?xml[^>]*\?>", text)
            if not document and head:
                text = text[head.end() :]
            p.Parse(text if document else f"<r>{text}</r>", True)
        except xml.parsers.expat.ExpatError:
            return False
        return True

    def check(texts: pd.Series) -> pd.Series:
        known = {t: ok(t) for t in texts.dropna().unique()}
        return pd.Series([known.get(t) for t in texts], dtype="boolean")

    check.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(check, "boolean")(_c(x))


def is_well_formed(x, document: bool = False) -> Column:
    """xml_is_well_formed_content, or _document."""
    return _parses(x, document)


def xmlparse(x, kind: str = "content") -> Column:
    """XMLPARSE(DOCUMENT | CONTENT x): the text itself, an error where it doesn't parse."""
    x = _c(x)
    return F.when(x.isNull() | _parses(x, kind == "document"), x).otherwise(F.raise_error(F.lit(f"invalid XML {kind}")).cast("string"))


def xmlserialize(x) -> Column:
    """XMLSERIALIZE(... AS text)."""
    return _c(x).cast("string")


def xmlconcat(*xs) -> Column:
    """Nulls are left out, null where all are; XML declarations of the parts go, their version stays where all agree on 1.1."""
    parts = [_c(x) for x in xs]
    bare = [F.regexp_replace(p, "^\\s*<\\?xml[^>]*\\?>", "") for p in parts]
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws("", *bare))


def xmlagg(x, *order) -> Column:
    """Concatenation of a group's values in a given order, nulls left out."""
    from quern.semantics import array_agg

    return F.array_join(array_agg(x, *order), "")


def xmlexists(path: str, x) -> Column:
    """XMLEXISTS(path PASSING x)."""
    return F.xpath_boolean(_c(x), F.lit(f"boolean({path})"))


def table_to_xml(df, name: str, nulls: bool = False, forest: bool = False) -> Column:
    """A column that gives each row of the table as an element; table_xml() joins them to one document."""
    cell = lambda c: F.coalesce(F.concat(F.lit(f"<{c}>"), xml_escape(F.col(c)), F.lit(f"</{c}>")), F.lit(f'<{c} xsi:nil="true"/>' if nulls else ""))
    tag = name if forest else "row"
    return F.concat(F.lit(f"<{tag}>"), *(cell(c) for c in df.columns), F.lit(f"</{tag}>"))


def table_xml(df, name: str, order: list[str], nulls: bool = False):
    """table_to_xml of a small table (one document, so one row): its rows in order inside one element."""
    rows = df.select(*(F.col(o).alias(f"__o{i}") for i, o in enumerate(order)), table_to_xml(df, name, nulls).alias("__x"))
    doc = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("*"))), lambda s: s["__x"]), "")
    return rows.agg(F.concat(F.lit(f'<{name} xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">'), doc, F.lit(f"</{name}>")).alias("table_to_xml"))


def json_input(s) -> Column:
    """The text where it is JSON, else an error."""
    s = _c(s)
    return F.when(s.isNull() | F.try_parse_json(s).isNotNull(), s).otherwise(F.raise_error(F.lit("invalid input syntax for type json")).cast("string"))


def extract_path(j, *keys) -> Column:
    """json #> path: the element as JSON text, strings in their quotes; null where there is none."""
    return F.to_json(F.variant_get(F.try_parse_json(_c(j)), _path(keys), "variant"))


def each(j) -> Column:
    """Map of keys to JSON texts of an object's values; explode it for rows."""
    return F.transform_values(F.from_json(_c(j), T.MapType(T.StringType(), T.VariantType())), lambda k, v: F.to_json(v))


def array_to_json(a) -> Column:
    return F.to_json(_c(a), {"ignoreNullFields": "false"})
