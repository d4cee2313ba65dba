"""XML as text: construction with escapes, well-formedness, and paths with namespaces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c


def escaped(x) -> Column:
    """Text as content of an element or of an attribute in double quotes."""
    out = _c(x).cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#x0d;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def element(name: str, attributes: dict | None = None, *content) -> Column:
    """XMLELEMENT: attributes that are null are left out; content is XML, so text goes through escaped. Without any: <name/>."""
    parts = [F.coalesce(F.concat(F.lit(f' {k}="'), F.replace(escaped(v), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit("")) for k, v in (attributes or {}).items()]
    inner = F.concat(*(F.coalesce(_c(c).cast("string"), F.lit("")) for c in content)) if content else F.lit("")
    head = F.concat(F.lit(f"<{name}"), *parts)
    return F.when(inner == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inner, F.lit(f"</{name}>")))


def forest(**values) -> Column:
    """XMLFOREST: an element for each value that isn't null."""
    return F.concat(*(F.coalesce(F.when(_c(v).isNotNull(), F.concat(F.lit(f"<{k}>"), escaped(v), F.lit(f"</{k}>"))), F.lit("")) for k, v in values.items()))


def concat(*xs) -> Column:
    """XMLCONCAT: nulls are left out; null if all are."""
    joined = F.concat_ws("", *map(_c, xs))
    return F.when(F.coalesce(*map(_c, xs)).isNotNull(), joined)


def comment(x) -> Column:
    """An error where the text holds -- or ends with -."""
    bad = F.contains(_c(x), F.lit("--")) | F.endswith(_c(x), F.lit("-"))
    return F.when(bad, F.raise_error(F.lit("invalid XML comment")).cast("string")).otherwise(F.concat(F.lit("<!--"), _c(x), F.lit("-->")))


def instruction(name: str, content=None) -> Column:
    """XMLPI."""
    return F.lit(f"<?{name}?>") if content is None else F.concat(F.lit(f"<?{name} "), F.ltrim(_c(content)), F.lit("?>"))


def root(x, version: str = "1.0", standalone: str | None = None) -> Column:
    """XMLROOT: the document with that declaration in place of its own."""
    head = f'<?xml version="{version}"' + (f' standalone="{standalone}"' if standalone else "") + "?>"
    return F.concat(F.lit(head), F.regexp_replace(_c(x), r"^\s*<\?xml\s[^>]*\?>\s*", ""))


def agg(x, *order) -> Column:
    """xmlagg in the order of the columns; nulls are left out."""
    rows = F.array_sort(F.collect_list(F.when(_c(x).isNotNull(), F.struct(*(_c(o).alias(f"o{i}") for i, o in enumerate(order)), _c(x).alias("x")))))
    return F.nullif(F.array_join(F.transform(rows, lambda r: r.x), ""), F.lit(""))


def is_well_formed(x, document: bool = True) -> Column:
    """Whether a text is a document, or content: any run of elements and text."""

    def run(s: pd.Series) -> pd.Series:
        from xml.parsers import expat

        def good(text):
            if text is None:
                return None
            try:
                expat.ParserCreate().Parse(text if document else f"<r>{text}</r>", True)
            except expat.ExpatError:
                return False
            return True

        return s.map(good, na_action=None).astype(object)

    return F.pandas_udf(run, "boolean")(_c(x))


def parse(x, document: bool = True) -> Column:
    """XMLPARSE: the text, or an error."""
    return F.when(is_well_formed(x, document), _c(x)).when(_c(x).isNotNull(), F.raise_error(F.lit("invalid XML content")).cast("string"))


def xpath(path: str, x, namespaces: dict[str, str] | None = None) -> Column:
    """Texts or attributes that a path (/a/b, //b, [n], [@k='v'], text(), @k, with prefixes) leads to, as an array; elements as XML."""

    def run(s: pd.Series) -> pd.Series:
        import re
        from xml.etree import ElementTree

        body, _, last = path.rpartition("/")
        wanted = last if last == "text()" or last.startswith("@") else ""
        steps = body if wanted else path

        def found(text):
            if text is None:
                return None
            top = ElementTree.Element("top")
            top.append(ElementTree.fromstring(text))
            relative = re.sub(r"^/(?=[^/])", "./", re.sub(r"^//", ".//", steps)) or "./*"
            out = []
            for e in top.findall(relative, namespaces or {}):
                if wanted == "text()":
                    out += [e.text] if e.text else []
                elif wanted:
                    out += [e.get(wanted[1:])] if e.get(wanted[1:]) is not None else []
                else:
                    e.tail = None
                    out.append(ElementTree.tostring(e, encoding="unicode"))
            return out

        return s.map(found, na_action=None)

    return F.pandas_udf(run, "array<string>")(_c(x))


def xpath_exists(path: str, x, namespaces: dict[str, str] | None = None) -> Column:
    return F.size(xpath(path, x, namespaces)) > 0


def of_table(df, name: str, key: str) -> Column:
    """table_to_xml as rows: each row as an element of its columns; nulls are left out."""
    return element("row", None, forest(**{c: c for c in df.columns}))
