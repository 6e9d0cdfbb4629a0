"""Page-level extraction from listing and search pages: Column -> Column over html or url.

Link prefix, class names and block markers are parameters; the defaults are the listing site's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import col
from ..functions.strings import cleaned

#: What block pages contain.
BLOCK_MARKERS = ("captcha-delivery.com", "geo.captcha-delivery.com", "datadome", "access blocked", "captcha")
#: Classes of the site's markup.
SUBLISTING_CLASS = "re-realEstateUnitsOld__item re-realEstateUnitsOld__item--block"
PAGE_LINK_CLASS = "in-paginationItem nd-button nd-button--ghost is-mobileHidden"
PAGE_STOP_CLASS = "nd-button nd-button--ghost is-disabled in-paginationItem is-mobileHidden"

#: An open script tag with an attribute, and the text up to the tag's end; no step back is ever taken (atomic groups, as
#: Java steps through a possessive loop character by character).
_SCRIPT = r"""<(?i:script)\b[^>]*\b(?i:%s)\s*=\s*["']%s["'](?>[^>]*)>((?>[^<]*)(?:<(?!/(?i:script)>)(?>[^<]*))*+)</(?i:script)>"""
_BY_ID = _SCRIPT % ("id", "(?i:__NEXT_DATA__)")
_BY_TYPE = _SCRIPT % ("type", "(?i:application/json)")
DETAIL = "$.props.pageProps.detailData"


def payload(html: Column | str) -> Column:
    """B1: the page's JSON text, unaltered; NULL if there is none."""
    found = (F.nullif(F.regexp_extract(col(html), p, 1), F.lit("")) for p in (_BY_ID, _BY_TYPE))
    return F.coalesce(*found)


def has_payload(html: Column | str) -> Column:
    """B2"""
    return F.coalesce(col(html).rlike(_BY_ID), F.lit(False))


def _keys(json: Column, path: str) -> Column:
    return F.json_object_keys(F.get_json_object(json, path))


def has_detail(html: Column | str) -> Column:
    """The key detailData is there, whatever its value."""
    return F.coalesce(F.array_contains(_keys(payload(html), "$.props.pageProps"), "detailData"), F.lit(False))


def has_sublistings(html: Column | str) -> Column:
    """More than one property; undecidable is false."""
    n = F.json_array_length(F.get_json_object(payload(html), f"{DETAIL}.realEstate.properties"))
    return F.coalesce(n > 1, F.lit(False))


def is_auction(html: Column | str) -> Column:
    """The first property has the key auction. A NULL page is none, a page without a payload or a property is one."""
    keys = _keys(payload(html), f"{DETAIL}.realEstate.properties[0]")
    return F.when(col(html).isNull(), False).when(keys.isNull(), True).otherwise(F.array_contains(keys, "auction"))


def block_markers(html: Column | str, markers: tuple[str, ...] = BLOCK_MARKERS) -> Column:
    """The markers found, in their order."""
    text = F.lower(F.coalesce(col(html), F.lit("")))
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(text, F.lower(m)))


def is_blocked(html: Column | str, markers: tuple[str, ...] = BLOCK_MARKERS) -> Column:
    return F.size(block_markers(html, markers)) > 0


def title(html: Column | str) -> Column:
    """NULL if there is none."""
    return F.nullif(cleaned(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def listing_id(url: Column | str) -> Column:
    """The last path segment if it is a number, else the one before, else NULL."""
    parts = F.filter(F.split(F.regexp_replace(col(url), r"[?#].*$", ""), "/"), lambda p: p != "")
    number = lambda i: F.when(F.try_element_at(parts, F.lit(i)).rlike(r"^\d+$"), F.try_element_at(parts, F.lit(i)).try_cast("bigint"))
    return F.coalesce(number(-1), number(-2))


def hrefs(html: Column | str, containing: str = "", class_name: str | None = None) -> Column:
    """Addresses of the links in page order, of one class or with some text in them."""
    if class_name is None:
        found = F.regexp_extract_all(col(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    else:
        tags = F.regexp_extract_all(col(html), F.lit(r"(?is)(<a\b[^>]*>)"), F.lit(1))
        tags = F.filter(tags, lambda t: F.contains(t, F.lit(f'class="{class_name}"')))
        found = F.transform(tags, lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1))
    return F.filter(found, lambda h: (h != "") & F.contains(h, F.lit(containing)))


def absolute(href: Column, site: str) -> Column:
    return F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).when(F.startswith(href, F.lit("/")), F.concat(F.lit(site), href)).otherwise(href)


def listing_links(html: Column | str, containing: str = "/annunci/", site: str = "https://www.listing.website", need_id: bool = True) -> Column:
    """Links to listings, absolute, those with an id, each once in page order."""
    urls = F.transform(hrefs(html, containing), lambda h: absolute(h, site))
    return F.array_distinct(F.filter(urls, lambda u: listing_id(u).isNotNull()) if need_id else urls)


def sublisting_links(html: Column | str, class_name: str = SUBLISTING_CLASS) -> Column:
    """B10"""
    return hrefs(html, "", class_name)


def listing_ids(links: Column) -> Column:
    """The ids of links; links without one are dropped."""
    return F.filter(F.transform(links, listing_id), lambda i: i.isNotNull())


def page_count(html: Column | str, link_class: str = PAGE_LINK_CLASS, stop_class: str = PAGE_STOP_CLASS) -> Column:
    """With one disabled item and two or more links the last but one link, else the last disabled item; 1 if unknown."""
    texts = lambda tag, name: F.regexp_extract_all(col(html), F.lit(rf"""(?is)<{tag}\b[^>]*class="{name}"[^>]*>\s*(.*?)\s*</{tag}>"""), F.lit(1))
    links, stops = texts("a", link_class), texts("div", stop_class)
    number = F.when((F.size(stops) == 1) & (F.size(links) >= 2), F.try_element_at(links, F.lit(-2))).otherwise(F.try_element_at(stops, F.lit(-1)))
    return F.coalesce(F.when(F.size(links) > 0, number.try_cast("int")), F.lit(1))
