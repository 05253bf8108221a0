"""URL and listing predicates, unescaping, harvesting, request URLs."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.functions.text import contains_any, strip
from stitchwork.rules import routing as R

# The standard's named references, from the standard library; names without a semicolon also match as a prefix.
_PREFIXES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"


def _code_point(number: Column) -> Column:
    """Character of a numeric reference; what the standard replaces is replaced."""
    latin = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)} | {0: "\ufffd", 13: "\r"}
    controls = ((number >= 1) & (number <= 8)) | ((number >= 14) & (number <= 31)) | (number == 11) | (number == 127) | (
        (number >= 0xFDD0) & (number <= 0xFDEF)) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    known = F.create_map(*[F.lit(x) for kv in latin.items() for x in kv])
    return (F.when(number.isNull() | (number > 0x10FFFF) | ((number >= 0xD800) & (number <= 0xDFFF)), "\ufffd")
            .when(number.isin(list(latin)), F.try_element_at(known, number.cast("int")))
            .when(controls, "").otherwise(plain))


def _unescaped(reference: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in html5.items() for x in kv])
    digits = F.ltrim(F.regexp_extract(reference, "^&#([0-9]+)", 1), F.lit("0"))
    hexed = F.ltrim(F.regexp_extract(reference, "^&#[xX]([0-9a-fA-F]+)", 1), F.lit("0"))
    name = F.substring(reference, 2, 33)
    prefix = F.regexp_extract(reference, f"^&({'|'.join(_PREFIXES)})", 1)
    return (F.when(reference.rlike("^&#[0-9]"), _code_point(F.when(F.length(digits) <= 9, F.concat(F.lit("0"), digits).cast("bigint"))))
            .when(reference.rlike("^&#"), _code_point(F.when(F.length(hexed) <= 8, F.conv(F.concat(F.lit("0"), hexed), 16, 10).cast("bigint"))))
            .when(F.map_contains_key(names, name), F.try_element_at(names, name))
            .when(prefix != "", F.concat(F.try_element_at(names, prefix), F.substr(name, F.length(prefix) + 1)))
            .otherwise(reference))


def unescape_url(url: Column) -> Column:
    """HTML-unescape in one pass, so an escaped ampersand does not start a second reference; then trim."""
    text = F.coalesce(url, F.lit(""))
    between, found = F.split(text, _REFERENCE, -1), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    plain = F.array_append(F.transform(found, _unescaped), F.lit(""))
    joined = F.array_join(F.zip_with(between, plain, lambda a, b: F.concat(a, b)), "")
    return strip(F.when(text.contains("&"), joined).otherwise(text))


def url_is_safe(url: Column) -> Column:
    return ~contains_any(F.lower(url), R.BLOCKED_URL_WORDS)


def url_path(url: Column) -> Column:
    """Path part: no scheme, host, query, parameters or fragment. Malformed URLs do not raise."""
    bare = F.regexp_replace(url, r"[?#;].*$", "")
    return F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def is_image_url(url: Column) -> Column:
    path = F.lower(url_path(F.coalesce(url, F.lit(""))))
    hit = F.lit(False)
    for ext in R.IMAGE_EXTENSIONS:
        hit = hit | path.endswith(ext)
    return hit


def is_video(post: Column) -> Column:
    domain = F.lower(F.coalesce(post["domain"], F.lit("")))
    return (F.coalesce(post["is_video"], F.lit(False))
            | F.coalesce(post["post_hint"].isin(R.VIDEO_HINTS), F.lit(False)) | domain.isin(R.VIDEO_DOMAINS))


def is_gone(post: Column) -> Column:
    mark = lambda c: F.coalesce(c.isin(R.GONE_MARKS), F.lit(False))
    return post["removed_by_category"].isNotNull() | mark(post["selftext"]) | mark(post["title"])


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def with_media_urls(posts: DataFrame, post: str, name: str = "urls") -> DataFrame:
    """Add the URLs of a post column: gallery first, then the direct link, then the preview.

    A gallery follows its item order when it has one and the map's order
    otherwise; only valid media count, and a missing source falls back to
    its last preview. Each kind is a column of its own before one is chosen.
    """
    p = F.col(post)
    none = F.array().cast("array<string>")
    ordered = F.filter(F.transform(F.coalesce(p["gallery_data"]["items"], F.array()), lambda i: i["media_id"]),
                       lambda i: F.coalesce(i != "", F.lit(False)))
    staged = posts.withColumns({
        "_media": p["media_metadata"], "_ordered": ordered,
        "_main": F.coalesce(_present(p["url_overridden_by_dest"]), p["url"], F.lit("")),
        "_preview": F.get(p["preview"]["images"], F.lit(0))["source"]["url"], "_skip": is_gone(p) | is_video(p)})

    def media_url(key: Column) -> Column:
        meta = F.try_element_at("_media", key)
        last = F.try_element_at(F.coalesce(meta["p"], F.array()), F.lit(-1))["u"]
        url = F.coalesce(_present(meta["s"]["u"]), _present(meta["s"]["gif"]), _present(last))
        return F.when(meta["status"] == "valid", url)

    keys = F.when(F.size("_ordered") > 0, F.col("_ordered")).otherwise(F.map_keys("_media"))
    # Only raw URLs here; entities are resolved once, on the kind that is used.
    gallery = F.when(F.col("_media").isNotNull(), F.array_compact(F.transform(keys, media_url)))
    kinds = staged.withColumns({
        "_gallery": F.coalesce(gallery, none),
        "_direct": F.when(is_image_url(F.col("_main")), F.array("_main")).otherwise(none),
        "_shown": F.when(F.coalesce("_preview", F.lit("")) != "", F.array("_preview")).otherwise(none)})
    chosen = (F.when(F.col("_skip"), none).when(F.size("_gallery") > 0, F.col("_gallery"))
              .when(F.size("_direct") > 0, F.col("_direct")).otherwise(F.col("_shown")))
    clean = F.filter(F.transform(chosen, unescape_url), lambda u: u != "")
    return kinds.select(*posts.columns, clean.alias(name))


def harvest_marked(html: Column) -> Column:
    """Source URLs in the result attribute of a search page, decoded, safe, first occurrence kept."""
    raw = F.regexp_extract_all(html, F.lit("&quot;murl&quot;:&quot;(http[^&]+)&quot;"), F.lit(1))
    decoded = F.transform(raw, percent_decode)
    return F.array_distinct(F.filter(decoded, url_is_safe))


def percent_decode(url: Column) -> Column:
    """Percent decoding that leaves plus signs and malformed escapes alone."""
    guarded = F.replace(F.regexp_replace(url, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(guarded), url)


def harvest_links(html: Column) -> Column:
    """Absolute image links of a page, without the search engine's own hosts."""
    raw = F.regexp_extract_all(html, F.lit("https?://[^\"'\\s<>\\\\]+?\\.(?:jpg|jpeg|png|webp)"), F.lit(0))
    keep = F.filter(raw, lambda u: ~contains_any(u, R.HARVEST_SKIPPED_HOSTS) & url_is_safe(u))
    return F.array_distinct(keep)


def form_encode(value: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def listing_url(target: Column, listing: Column, query: Column, sort: Column, after: Column, limit: Column,
                period: Column, host: str = "https://www.reddit.com") -> Column:
    """Request URL of one catalog row: full URL, search, or feed."""
    t = strip(target)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    pair = lambda name, value: F.concat(F.lit(name + "="), form_encode(value.cast("string")))
    optional = lambda cond, c: F.when(cond, c)
    has_query, has_sort, has_after, has_period = ~blank(query), ~blank(sort), ~blank(after), ~blank(period)

    base = F.regexp_extract(t, r"^(https?://[^/?#]+)", 1)
    fragment = F.regexp_extract(t, r"(#.*)$", 1)
    raw_query = F.regexp_extract(t, r"\?([^#]*)", 1)
    path = F.regexp_extract(t, r"^https?://[^/?#]+([^?#]*)", 1)
    json_path = F.when(path.endswith(".json"), path).otherwise(
        F.concat(F.regexp_replace(path, "/+$", ""), F.lit(".json")))
    has_param = lambda name: raw_query.rlike(f"(^|&){name}=[^&]")
    kept = F.array_join(F.filter(F.split(raw_query, "&"), lambda p: p.rlike("^[^=]+=.")
                                 & ~p.startswith("limit=")
                                 & ~(F.coalesce(has_after, F.lit(False)) & p.startswith("after="))), "&")
    full = F.concat(base, json_path, F.lit("?"), F.concat_ws(
        "&", F.when(kept != "", kept), pair("limit", limit), optional(has_after, pair("after", after)),
        optional(has_query & ~has_param("q"), pair("q", query)),
        optional(has_sort & ~has_param("sort"), pair("sort", sort)),
        optional(has_period & ~has_param("t"), pair("t", period))), fragment)

    sub = F.btrim(F.regexp_replace(t, "^[rR]/", ""), F.lit("/"))
    common = F.lower(sub).isin("all", "reddit", "")
    search_params = F.concat_ws(
        "&", pair("q", query), pair("limit", limit), pair("sort", F.when(has_sort, sort).otherwise("top")),
        pair("t", F.when(has_period, period).otherwise("all")), optional(has_after, pair("after", after)),
        F.when(common, "type=link").otherwise("restrict_sr=1"))
    search = F.concat(F.lit(host), F.when(common, F.lit("")).otherwise(F.concat(F.lit("/r/"), sub)),
                      F.lit("/search.json?"), search_params)
    feed_name = F.when(~blank(listing), listing).otherwise("hot")
    feed = F.concat(F.lit(host + "/r/"), sub, F.lit("/"), feed_name, F.lit(".json?"), F.concat_ws(
        "&", pair("limit", limit), optional(has_after, pair("after", after)),
        optional((feed_name == "top") & has_period, pair("t", period))))
    return F.when(t.rlike("^https?://"), full).when(has_query, search).otherwise(feed)


def resized_url(url: Column, width: int) -> Column:
    joiner = F.when(url.contains("?"), "&").otherwise("?")
    return F.concat(url, joiner, F.lit(f"w={width}&q=85&auto=format&fit=crop"))
