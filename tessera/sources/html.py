"""HTML pages as blocks of text."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import trimmed

# Tags that part blocks, the commonest character references, and sizes of blocks.
BLOCK_TAGS = "h1|h2|h3|p|li|br|div"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
SIZES = {"h1": 22, "h2": 16, "h3": 13}
#: Stand for the start and end of an opening tag, and for a closing one, while a page is taken apart: no characters of texts.
_OPEN, _NAMED, _CLOSE = "\ufdd4", "\ufdd5", "\ufdd6"
#: Code points that references to them do not mean: the C1 controls, read as Windows-1252.
_CONTROLS = {i: bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)}


def unescaped(text: Column) -> Column:
    """text with its character references resolved: by number, decimal or not, and by the names of HTML 5, the old ones without semicolon too.

    A space that does not break is a plain one. Unknown names stay; numbers
    that are no characters are U+FFFD.
    """
    names = F.create_map(*[F.lit(x) for pair in html5.items() for x in pair])
    longest = max(len(n) for n in html5 if not n.endswith(";"))

    def named(s: Column) -> Column:
        whole = F.regexp_extract(s, "^[A-Za-z0-9]+;", 0)
        old = F.filter(F.transform(F.sequence(F.lit(longest), F.lit(2), F.lit(-1)), lambda n: F.substr(s, F.lit(1), n)), lambda n: ~n.endswith(";") & F.try_element_at(names, n).isNotNull())
        name = F.when((whole != "") & F.try_element_at(names, whole).isNotNull(), whole).otherwise(F.get(old, F.lit(0)))
        return F.when(name.isNotNull(), F.concat(F.try_element_at(names, name), F.substr(s, F.length(name) + 1))).otherwise(F.concat(F.lit("&"), s))

    def numbered(s: Column) -> Column:
        ref = F.regexp_extract(s, "^#([xX][0-9A-Fa-f]+|[0-9]+);?", 0)
        digits = F.regexp_extract(ref, "[0-9A-Fa-f]+(?=;?$)", 0)
        short = F.right(F.concat(F.lit("0" * 9), digits), F.lit(9))
        large = F.length(F.regexp_replace(digits, "^0+", "")) > 8
        code = F.when(large, F.lit(0)).otherwise(F.when(F.lower(F.substr(ref, F.lit(2), F.lit(1))) == "x", F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("long"))
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        control = F.try_element_at(F.create_map(*[F.lit(x) for pair in _CONTROLS.items() for x in pair]), code.cast("int"))
        char = F.when(bad, "\ufffd").otherwise(F.coalesce(control, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        return F.when(ref == "", F.concat(F.lit("&"), s)).otherwise(F.concat(char, F.substr(s, F.length(ref) + 1)))

    pieces = F.split(text, "&", -1)
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda s: F.when(s.startswith("#"), numbered(s)).otherwise(named(s)))
    whole = F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))
    return F.when(F.contains(text, F.lit("&")), F.replace(whole, F.lit("\u00a0"), F.lit(" "))).otherwise(text)


def common(text: Column) -> Column:
    """text with the seven references resolved that pages have most often, and no others."""
    for ref, char in ENTITIES:
        text = F.replace(text, F.lit(ref), F.lit(char))
    return text


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", resolve: Callable[[Column], Column] = unescaped) -> DataFrame:
    """key, tag, size, bold, text: text between block tags, under the last one opened; styles and scripts aside. All inside the page's row.

    resolve: what is done to character references, unescaped() or common().
    """
    body = F.regexp_replace(F.regexp_replace(F.col(html), "(?is)<style[^>]*>.*?</style>", ""), "(?is)<script[^>]*>.*?</script>", "")
    # the page in parts from each opening tag on, and these in parts by closing ones
    plain = F.regexp_replace(body, f"[{_OPEN}{_NAMED}{_CLOSE}]", "")
    closed = F.regexp_replace(F.concat(F.lit("<p>"), plain), f"(?is)</({BLOCK_TAGS})[^>]*>", _CLOSE)
    opened = F.regexp_replace(closed, f"(?is)<({BLOCK_TAGS})[^>]*>", f"{_OPEN}$1{_NAMED}")
    parts = F.transform(F.filter(F.split(opened, _OPEN, -1), lambda p: p != ""), lambda p: F.split(p, _NAMED, 2))
    text = lambda s: trimmed(F.regexp_replace(s, "(?s)<[^>]*>", ""))
    blocks = F.flatten(F.transform(parts, lambda p: F.transform(F.split(F.get(p, F.lit(1)), _CLOSE, -1), lambda s: F.struct(F.lower(F.get(p, F.lit(0))).alias("tag"), text(s).alias("text")))))
    rows = pages.select(key, F.inline(F.filter(blocks, lambda b: b["text"] != "")))
    text = resolve(F.col("text"))
    return rows.select(key, "tag", text.alias("text"), F.coalesce(F.create_map(*[F.lit(x) for e in SIZES.items() for x in e])[F.col("tag")], F.lit(11)).alias("size"), F.col("tag").isin(*SIZES).alias("bold"))
