"""URL functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track, compared in lower case.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "gclsrc", "dclid", "yclid", "twclid", "igshid",
    "ref", "referrer", "source", "mc_eid", "mc_cid", "_ga", "_gl",
    "msclkid", "zanpid", "origin",
]
# Path endings of what is not a page.
FILE_ENDINGS = (
    "pdf zip gz tar rar 7z exe dmg pkg deb rpm jpg jpeg png gif svg webp ico bmp tiff "
    "mp3 mp4 mpeg avi mov wmv flv ogg webm css js json xml rss atom woff woff2 ttf eot "
    "csv xls xlsx doc docx ppt pptx"
).split()
# Where a URL names its language.
LOCALE = r"(?i)/([a-z]{2}(?:-[a-z]{2})?)/|[?&]lang(?:uage)?=([a-z]{2})|[?&]locale=([a-z]{2})"
PATH_SAFE = r"[A-Za-z0-9_.~/:@!$&'()*+,;=%-]"
WORD_SAFE = r"[A-Za-z0-9_.~-]"


def percent_encoded(text: Column, safe: str, space: str | None = None) -> Column:
    """Percent-encode the UTF-8 bytes of each character outside ``safe``."""
    coded = F.transform(
        F.split(text, ""),
        lambda c: (F.when(c == " ", space) if space else F.when(F.lit(False), "")).when(c.rlike(f"^{safe}$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")),
    )
    return F.when(text.rlike(f"^{safe}*$"), text).otherwise(F.array_join(coded, ""))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def clean_query(query: Column) -> Column:
    """Without tracking keys, decoded and encoded again, order and blank values kept; empty parts go."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING))
    return F.array_join(F.transform(kept, lambda p: F.concat(percent_encoded(p["k"], WORD_SAFE, "+"), F.lit("="), percent_encoded(p["v"], WORD_SAFE, "+"))), "&")


def with_scheme(url: Column) -> Column:
    """White space and control characters out, https before what has no scheme; null when nothing is left."""
    u = F.regexp_replace(url, r"(?U)[\x00-\x1f\x7f\s]", "")
    u = F.when(u.startswith("http://") | u.startswith("https://"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(F.concat(F.lit("https://"), u))
    return F.when(~u.isin("https://", "https:"), u)


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def sanitise(url: Column) -> Column:
    """The canonical form of a URL, null when it has no http(s) host with a dot."""
    u = with_scheme(url)
    host = authority(u)
    last = r"^(.*?)(?:;([^/]*))?$"
    whole = path(u)
    plain, params = F.regexp_extract(whole, last, 1), F.regexp_extract(whole, last, 2)
    q = clean_query(query(u))
    out = F.concat(
        F.lower(F.regexp_extract(u, r"^(https?)://", 1)),
        F.lit("://"),
        F.lower(host),
        percent_encoded(plain, PATH_SAFE),
        F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""),
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
    )
    good = F.contains(F.substring_index(host, ":", 1), F.lit(".")) & (F.contains(host, F.lit("[")) == F.contains(host, F.lit("]")))
    return F.when(good, out)


def is_page_url(url: Column) -> Column:
    return ~path(url).rlike(r"(?i)\.(" + "|".join(FILE_ENDINGS) + ")$")


def is_http_url(url: Column) -> Column:
    return url.rlike(r"^https?://[^/?#]+")


def bare_host(url: Column) -> Column:
    """The authority without one leading www."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def on_domain(url: Column, domain: str) -> Column:
    return bare_host(url) == domain.removeprefix("www.")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; * crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        end = pattern.find("]", i + 1 + (pattern[i : i + 1] == "!")) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and end > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out += f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]"
            i = end + 1
        else:
            out += re.escape(c)
    return rf"(?s)\A{out}\z"


def matches(url: Column, pattern: str | None) -> Column:
    """re:<regex> searches, * or ? match the path as a glob, anything else is a substring; a bad regex is a substring too."""
    if not pattern:
        return F.lit(True)
    if pattern.startswith("re:"):
        try:
            re.compile(pattern[3:])
            return url.rlike("(?iu)" + pattern[3:])
        except re.error:
            pattern = pattern[3:]
    elif "*" in pattern or "?" in pattern:
        return path(url).rlike(glob_regex(pattern))
    return F.contains(F.lower(url), F.lit(pattern.lower()))


def locale(url: Column) -> Column:
    """The language code of a URL in lower case; null when it has none."""
    found = [F.nullif(F.regexp_extract(url, LOCALE, i), F.lit("")) for i in (1, 2, 3)]
    return F.lower(F.coalesce(*found))


def resolve(href: Column, page_url: Column) -> Column:
    """An absolute link against the site's root."""
    base = origin(page_url)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.substring_index(base, "//", 1), href))
        .when(href.startswith("/"), F.concat(base, href))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(base, href))
        .otherwise(F.concat(base, F.lit("/"), F.regexp_replace(href, r"^(?:\.{1,2}/)+", "")))
    )


def is_followable(href: Column) -> Column:
    return ~(href.startswith("#") | href.startswith("mailto:") | href.startswith("tel:"))


def label(url: Column, width: int = 72) -> Column:
    """Host and path for display, cut to the width, ?… when there is a query."""
    whole = F.concat(authority(url), F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/")))
    cut = F.when(F.length(whole) > width, F.concat(F.substring(whole, 1, width - 4), F.lit("…"))).otherwise(whole)
    return F.concat(cut, F.when(query(url) != "", F.lit("?…")).otherwise(""))
