"""Ids, hosts and links in URLs, mail bodies and HTML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import or_else, squeezed

#: Where each provider's URL carries its posting id.
PROVIDER_IDS = {
    "alljobs": r"[?&]JobID=(\d+)",
    "drushim": r"drushim\.co\.il/job/([^/]+)",
    "indeed": r"[?&]jk=([^&]+)",
    "linkedin": r"linkedin\.com/(?:comm/)?jobs/view/(?:[^/?]*-)?(\d+)",
    "jobmaster": r"jobmaster\.co\.il.*key=(\d+)",
}


def provider_id(url: Column, provider: str) -> Column:
    """The posting id that a provider's URL carries, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), "(?i)" + PROVIDER_IDS[provider], 1), F.lit(""))


def provider_key(url: Column, providers: Sequence[str]) -> Column:
    """`provider:id` of the first provider that has one, else null."""
    return F.coalesce(*(F.concat(F.lit(f"{p}:"), provider_id(url, p)) for p in providers))


def host(url: Column) -> Column:
    """Host in lower case without www., empty if the URL has none."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def company_from_link(url: Column) -> Column:
    name = F.split(host(url), r"\.").getItem(0)
    return or_else(name, F.lit("Unknown company"))


def host_within(host_col: Column, domain: Column) -> Column:
    """The host is the domain or below it."""
    return (host_col == domain) | F.endswith(host_col, F.concat(F.lit("."), domain))


def best_apply_link(apply_options: Column, share_link: Column, related_links: Column, extension_link: Column) -> Column:
    """First apply option, share link, first related link, extension link; empty if there is none."""
    first = lambda a: F.get(a, F.lit(0))["link"]
    return or_else(first(apply_options), share_link, first(related_links), extension_link, F.lit(""))


def links_in_text(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://[^\s<>\"')]+)"), F.lit(1))


def links_in_html(html: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def unique_links(links: Column, most: int = 80) -> Column:
    """Cleaned links, each once, the first `most`."""
    cleaned = F.transform(links, lambda x: F.regexp_replace(F.trim(x), r"[),.;\]]+$", ""))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda x: F.startswith(x, F.lit("http")))), 1, most)


def strip_html(html: Column) -> Column:
    """Text of an HTML string: scripts and styles out, tags as spaces, the common entities resolved, squeezed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeezed(out)


def absolute(link: Column, base: str) -> Column:
    link = F.coalesce(link, F.lit(""))
    return F.when(link == "", "").when(F.rlike(link, F.lit("(?i)^https?://")), link).when(F.startswith(link, F.lit("//")), F.concat(F.lit("https:"), link)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(link, F.lit("/"))))


def without_redirect(url: Column) -> Column:
    """Where a search engine's redirect (an absolute URL with the path /url) leads, by its parameter q; other links as they are."""
    link = F.coalesce(url, F.lit(""))
    goal = F.regexp_extract(link, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*/url\?(?:[^#]*&)?q=([^&#]+)", 1)
    return F.coalesce(F.nullif(F.try_url_decode(goal), F.lit("")), link)


def normalized_url(url: Column) -> Column:
    """Without fragment, query and closing slash, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[?#].*$", ""), "/+$", ""))
