"""Text functions as column expressions; they stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpie import config

#: Exotic spaces, dashes, quotes and bullets, and what they become; a zero-width space is dropped.
FOREIGN = "\u00a0\u2002\u2003\u2009\u202f\u2013\u2014\u201c\u201d\u2018\u2019\u25cf\u200b"
PLAIN = "     --\"\"''\u2022"
#: Names of specifications and the wording that searches meet more often.
SPEC_NAMES = {
    "chipset": "chip xử lý (chipset)",
    "dung lượng ram": "bộ nhớ ram",
    "bộ nhớ trong": "bộ nhớ trong (rom)",
    "camera sau": "camera sau (máy ảnh chính)",
    "camera trước": "camera trước (máy ảnh selfie)",
}
#: Fixed value: where a policy text is split, before a heading at the beginning of a line.
HEADING = r"\n(?=(?:Điều\s+\d+)|(?:(?:\d+(?:\.\d+)*|[A-ZĐ]+|[a-z]|\([i-vx]+\))\.\s+)|(?:\([i-vx]+\)\s+))"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), FOREIGN, PLAIN)


def clean_lines(c: Column) -> Column:
    """Stripped lines without the blank ones."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda x: x != ""), "\n")


def base_name(c: Column) -> Column:
    """A product name cut before its storage size, and before the first bar or capital I."""
    no_prefix = F.replace(c, F.lit("Điện thoại "), F.lit(""))
    return strip(F.split(F.split(no_prefix, r"(?iU)\s+\d+(?:GB|TB)")[0], r"(?U)\s*[|I]\s*")[0])


def without_ad_tail(c: Column, store: str | None = None) -> Column:
    return F.regexp_replace(c, rf"(?iuUd)Mua\s+.*?\s+giá\s+rẻ\s+tại\s+{store or config.STORE}.*", "")


def sentences(c: Column) -> Column:
    return F.split(c, "(?<=[.!?]) +", -1)


def tokens(c: Column) -> Column:
    """The default tokenizer: lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def spec_name(key: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SPEC_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(known, strip(F.lower(key))), key)


def spec_value(key: Column, value: Column) -> Column:
    flat = F.replace(value, F.lit("\n"), F.lit(", "))
    bare = (strip(F.lower(key)) == "chipset") & ~F.startswith(F.lower(flat), F.lit("chip"))
    return F.when(bare, F.concat(F.lit("Chip "), flat)).otherwise(flat)


def url_id(url: Column) -> Column:
    """The last part of a URL's path, without .html."""
    return F.replace(F.element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), -1), F.lit(".html"), F.lit(""))


def resolve_url(base: str, href: Column) -> Column:
    """href against base, as browsers do: whole, scheme-relative, rooted, query, fragment or relative."""
    from urllib.parse import urljoin, urlsplit

    at = urlsplit(base)
    root = f"{at.scheme}://{at.netloc}"
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(f"{at.scheme}:"), href))
        .when(href.startswith("/"), F.concat(F.lit(root), href))
        .when(href.startswith("#"), F.concat(F.lit(urljoin(base, "").split("#")[0]), href))
        .when(href.startswith("?"), F.concat(F.lit(root + at.path), href))
        .otherwise(F.concat(F.lit(urljoin(base, ".")), href))
    )


def is_junk(text: Column, title: Column) -> Column:
    """A short text that says no more than its title."""
    t = strip(text)
    return (F.length(t) < config.JUNK_CHARS) & (F.contains(title, t) | F.contains(t, title))


def fallback_id(id_: Column, chunk_id: Column, text: Column) -> Column:
    return F.coalesce(id_, chunk_id, F.md5(text))


def preview(text: Column, n: int = 200) -> Column:
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def numbered(prefix: str, width: int, n: Column) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n)


def stock_text(stock: Column) -> Column:
    """A stock entry that is a string, or a JSON list of strings."""
    return F.when(stock.startswith("["), F.array_join(F.from_json(stock, "array<string>"), ", ")).otherwise(stock)


#: The wording of chunks, in which {0}, {1}, ... stand for the values; searches are made for these words.
WORDING = {
    "specs": "Thông số kỹ thuật chi tiết của sản phẩm {0}:\n",
    "spec": "Sản phẩm {0} có thông số {1} là {2}.",
    "variants": "Các phiên bản màu sắc, giá bán và tình trạng kho hàng hiện tại của sản phẩm {0}:\n",
    "variant": "Sản phẩm {0} phiên bản màu {1} có giá bán là {2} và tình trạng kho hàng là {3}.",
    "description": "Mô tả chi tiết và tính năng sản phẩm {0} (Phần {1}):\n{2}",
    "faq": "[FAQ Sản phẩm {0}]\nCâu hỏi: {1}\nTrả lời: {2}",
    "policy": "[Chính sách {0}] - {1}\nChủ đề: {2}\nNội dung:\n{3}",
    "context": "[Tài liệu {0} | {1} - {2}]\n{3}",
    "no color": "Không xác định",
    "no price": "Liên hệ",
    "no stock": "Hết hàng",
}


def worded(key: str, *values: Column) -> Column:
    """A wording with its values; null where one is null."""
    parts = re.split(r"\{(\d)\}", WORDING[key])
    return F.concat(*(values[int(p)] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p))


def specs_text(name: Column, specs: Column) -> Column:
    """specs: array of (key, value); entries without a value are left out, the header stays."""
    line = lambda e: worded("spec", name, spec_name(e["key"]), spec_value(e["key"], e["value"]))
    kept = F.filter(specs, lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.concat(worded("specs", name), F.array_join(F.transform(kept, line), "\n"))


def variants_text(name: Column, variants: Column) -> Column:
    def line(v: Column) -> Column:
        get = lambda k: F.coalesce(v[k], F.lit(WORDING[f"no {k}"]))
        return worded("variant", name, get("color"), get("price"), stock_text(get("stock")))

    return F.concat(worded("variants", name), F.array_join(F.transform(variants, line), "\n"))


def description_text(name: Column, part: Column, text: Column) -> Column:
    return worded("description", name, part.cast("string"), text)


def faq_text(name: Column, q: Column, a: Column) -> Column:
    return worded("faq", name, q, a)


def policy_text(title: Column, sub_title: Column, text: Column, store: str | None = None) -> Column:
    return worded("policy", F.lit(store or config.STORE), title, sub_title, text)


def context_block(rank: Column, kind: Column, name: Column, text: Column) -> Column:
    return worded("context", rank.cast("string"), kind, name, text)


def answer_html(c: Column) -> Column:
    """Escaped text with bold, italics, bullets and line breaks as HTML."""
    s = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    for pattern, to in ((r"\*\*(.*?)\*\*", "<strong>$1</strong>"), (r"__(.*?)__", "<strong>$1</strong>"), (r"\*(.*?)\*", "<em>$1</em>"), (r"(?m)^\s*[-*]\s+(.*)$", "• $1"), (r"\n", "<br>")):
        s = F.regexp_replace(s, pattern, to)
    return s
