"""URL canonicalisation and page-graph keys as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.functions.memo import memo
from factsieve.functions.text import let, text_or_empty

# Query parameters that never change what a page shows.
TRACKING_PARAM = r"(?i)^(utm_|fbclid$|gclid$|msclkid$|mc_cid$|mc_eid$|ref$|referrer$|_ga$|yclid$|igshid$)"

# Query parameters that only pick a rendition of an image.
IMAGE_SIZE_PARAMS = (
    "w", "h", "width", "height", "q", "quality", "fit", "crop", "dpr",
    "format", "fm", "auto", "resize", "size", "s", "tr", "c",
)

# File extensions that are never an HTML page.
NON_HTML_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "bmp", "ico", "tiff",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv",
    "zip", "rar", "7z", "tar", "gz",
    "mp3", "mp4", "webm", "avi", "mov", "wmv", "ogg", "wav", "m4a",
    "css", "js", "json", "xml", "rss", "atom", "woff", "woff2", "ttf", "eot",
    "exe", "dmg", "apk",
)

# Fixed value: extensions that belong to the plumbing of a page URL.
PAGE_EXTENSION = r"(?i)\.(html?|php|aspx?|jsp|jspx|shtml|cfm|do)$"

# Fixed value: hrefs that never lead to a page.
UNUSABLE_HREF = r"(?i)^(javascript|mailto|tel|sms|data|about|blob|#)"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"

# Addresses spelt as a browser would report them (lower-case host, no port, nothing to escape, no dot segments, no fragment), and
# those of them that are their own key: no query, or one parameter that tracks nobody and has nothing to encode.
_SAFE = r"A-Za-z0-9_~%=+,;:@!*&.\-"
_PLAIN = rf"^(?![^?]*/\.)https?://[a-z0-9.\-]+/[{_SAFE}/]*(?:\?[{_SAFE}/]+)?\z"
_TRACKED = TRACKING_PARAM.replace("(?i)^(", "(?i:").replace("$", "=")
_PLAIN_KEY = (
    rf"^(?!https?://www\.)(?![^?]*/\.)https?://[a-z0-9.\-]+/(?:[{_SAFE}/]*[{_SAFE}])?(?:\?(?!{_TRACKED})[A-Za-z0-9_]+=[A-Za-z0-9_]*)?\z"
)
_PLAIN_SITE = r"^https?://(?!www\.)(?:[a-z0-9\-]+\.)*([a-z0-9\-]+\.[a-z0-9\-]+)(?:[/?#]|\z)"


def _percent_encode(c: Column) -> Column:
    """Escape what may not stand literally in a path or query; existing escapes stay."""
    def chunk(part: Column) -> Column:
        encoded = F.url_encode(part)
        plain = part
        for raw, escaped in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"), ("{", "%7B"), ("}", "%7D")):
            plain = F.replace(plain, F.lit(raw), F.lit(escaped))
        return F.when(part.rlike(r"^[^\x00-\x7f]"), encoded).otherwise(plain)

    chunks = F.regexp_extract_all(c, F.lit(r"[^\x00-\x7f]+|[\x00-\x7f]+"), F.lit(0))
    return F.when(c.rlike(r"[^\x21-\x7e]|[\"<>`{}]"), F.array_join(F.transform(chunks, chunk), "")).otherwise(c)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.array_join(folded, "/")).otherwise(path)


def _authority(u: Column) -> Column:
    """``struct(scheme, host, port)`` as they are written, scheme and host in lower case."""
    def split(a: Column) -> Column:
        return F.struct(
            a["scheme"].alias("scheme"), F.lower(F.regexp_extract(a["text"], r"^(\[[^\]]*\]|[^:]*)", 1)).alias("host"),
            F.when(a["text"].contains(":"), F.regexp_extract(a["text"], r":([0-9]+)$", 1)).otherwise(F.lit("")).alias("port"),
        )

    return let(
        F.struct(
            F.lower(F.regexp_extract(u, _SCHEME, 1)).alias("scheme"),
            F.regexp_replace(F.regexp_extract(u, _SCHEME + r"([^/?#\\]*)", 2), "^.*@", "").alias("text"),
        ),
        split,
    )


def _usable(host: Column) -> Column:
    """Can this be a host? A text that is no URL has none."""
    return (host != "") & ~host.rlike(r"[\s<>^|%\"]")


@memo
def url_parts(c: Column) -> Column:
    """``struct(scheme, host, port, path, query, fragment)`` of an absolute URL, else null."""
    # Each pattern is tried once: what several tests need is bound before they use it.
    def build(u: Column) -> Column:
        written = F.struct(
            _authority(u).alias("at"), F.regexp_extract(u, _SCHEME + r"[^/?#\\]*([^?#]*)", 2).alias("path"),
            F.when(u.contains("?"), F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)).otherwise(F.lit("")).alias("query"),
            F.when(u.contains("#"), F.regexp_extract(u, r"(#.*)$", 1)).otherwise(F.lit("")).alias("fragment"),
        )

        def parts(w: Column) -> Column:
            scheme, host, port = w["at"]["scheme"], w["at"]["host"], w["at"]["port"]
            default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
            made = F.struct(
                scheme.alias("scheme"),
                host.alias("host"),
                F.when(default, F.lit("")).otherwise(port).alias("port"),
                F.when(w["path"] == "", F.lit("/")).otherwise(let(_percent_encode(w["path"]), _fold_dots)).alias("path"),
                _percent_encode(w["query"]).alias("query"),
                w["fragment"].alias("fragment"),
            )
            return F.when(_usable(host), made)

        return let(written, parts)

    return let(F.trim(text_or_empty(c)), build)


def _origin(p: Column) -> Column:
    return F.concat(
        p["scheme"], F.lit("://"), p["host"],
        F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(F.lit("")),
    )


def _query_suffix(query: Column) -> Column:
    return F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))


@memo
def url_origin(c: Column) -> Column:
    return let(url_parts(c), lambda p: F.when(p["scheme"].isin("http", "https"), _origin(p)))


def url_host(c: Column) -> Column:
    def host(a: Column) -> Column:
        return F.when(_usable(a["host"]), a["host"])

    return let(F.trim(text_or_empty(c)), lambda u: let(_authority(u), host))


def url_path(c: Column) -> Column:
    return let(url_parts(c), lambda p: p["path"])


@memo
def canonical_url(c: Column) -> Column:
    """Absolute http(s) URL in the spelling a browser would report, else null."""
    taken_apart = let(
        url_parts(c),
        lambda p: F.when(
            p["scheme"].isin("http", "https"),
            F.concat(_origin(p), p["path"], _query_suffix(p["query"]), p["fragment"]),
        ),
    )
    return F.when(c.rlike(_PLAIN), c).otherwise(taken_apart)


@memo
def absolutize(href: Column, base: Column) -> Column:
    """Resolve ``href`` against ``base``; null for hrefs that are not http(s) pages."""
    def resolve(h: Column) -> Column:
        def against(b: Column) -> Column:
            directory = F.regexp_replace(b["path"], "[^/]*$", "")
            joined = (
                F.when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
                .when(h.startswith("/"), F.concat(_origin(b), h))
                .when(h.startswith("?"), F.concat(_origin(b), b["path"], h))
                .otherwise(F.concat(_origin(b), directory, h))
            )
            return joined

        absolute = F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h).otherwise(let(url_parts(base), against))
        usable = (h != "") & ~h.rlike(UNUSABLE_HREF)
        return F.when(usable, let(absolute, canonical_url))

    return let(F.trim(text_or_empty(href)), resolve)


def _kept_params(query: Column, drop) -> Column:
    """Query parameters that matter, sorted by name and re-encoded."""
    def pair(p: Column, i: Column) -> Column:
        raw_name = F.regexp_extract(p, "^([^=]*)", 1)
        raw_value = F.regexp_extract(p, "^[^=]*=(.*)$", 1)
        name = F.coalesce(F.try_url_decode(raw_name), raw_name)
        value = F.coalesce(F.try_url_decode(raw_value), raw_value)
        return F.struct(F.lower(name).alias("sort"), i.alias("at"), name.alias("name"), value.alias("value"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~drop(p["name"])))
    return F.array_join(
        F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))),
        "&",
    )


@memo
def normalize_url(c: Column) -> Column:
    """Key under which two spellings of one page are the same visit."""
    def build(p: Column) -> Column:
        host = F.regexp_replace(p["host"], r"^www\.", "")
        path = F.when(F.length(p["path"]) > 1, F.regexp_replace(p["path"], "/$", "")).otherwise(p["path"])
        query = F.when(p["query"] == "", F.lit("")).otherwise(
            _kept_params(p["query"], lambda n: n.rlike(TRACKING_PARAM))
        )
        port = F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(F.lit(""))
        return F.concat(p["scheme"], F.lit("://"), host, port, path, _query_suffix(query))

    return F.when(c.rlike(_PLAIN_KEY), c).otherwise(F.coalesce(let(url_parts(c), build), c.cast("string")))


@memo
def image_identity(c: Column) -> Column:
    """Key under which two renditions of one image are the same image."""
    def build(p: Column) -> Column:
        path = F.regexp_replace(p["path"], r"(?i)/(?:w|h|c|q)_\d+(?:,[a-z]+_[\w.]+)*/", "/")
        path = F.regexp_replace(path, r"/\d{2,4}x\d{2,4}/", "/")
        path = F.regexp_replace(path, r"(?i)[-_]\d{2,4}x\d{2,4}(\.[a-z0-9]+)$", "$1")
        path = F.regexp_replace(path, r"(?i)[-_](?:thumb|thumbnail|small|medium|large|scaled)(\.[a-z0-9]+)$", "$1")
        query = F.when(p["query"] == "", F.lit("")).otherwise(
            _kept_params(
                p["query"],
                lambda n: F.lower(n).isin(*IMAGE_SIZE_PARAMS) | n.rlike(TRACKING_PARAM),
            )
        )
        return F.concat(_origin(p), path, _query_suffix(query))

    return F.coalesce(let(url_parts(c), build), c.cast("string"))


@memo
def site_root(c: Column) -> Column:
    """Last two labels of the host: the unit "same site" compares."""
    host = F.regexp_replace(url_host(c), r"^www\.", "")
    taken_apart = let(host, lambda h: F.coalesce(F.nullif(F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1), F.lit("")), h))
    return F.when(c.rlike(_PLAIN_SITE), F.regexp_extract(c, _PLAIN_SITE, 1)).otherwise(taken_apart)


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(site_root(a) == site_root(b), F.lit(False))


@memo
def looks_non_html(c: Column) -> Column:
    extension = F.lower(F.regexp_extract(url_path(c), r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.coalesce(extension.isin(*NON_HTML_EXTENSIONS), F.lit(False))


@memo
def url_tokens(c: Column) -> Column:
    """Path and query words longer than one character, page extension removed."""
    words = let(
        url_parts(c),
        lambda p: F.lower(F.concat(F.regexp_replace(p["path"], PAGE_EXTENSION, ""), F.lit(" "), p["query"])),
    )
    return F.coalesce(
        F.filter(F.split(words, "[^a-z0-9]+"), lambda t: F.length(t) > 1),
        F.array().cast("array<string>"),
    )


@memo
def validate_url(c: Column) -> Column:
    """``struct(ok, url, reason)`` for a user-supplied address; bare hosts get a scheme."""
    def build(raw: Column) -> Column:
        has_scheme = raw.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://") | raw.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:(?![0-9])")
        local = raw.rlike(r"(?i)^(localhost|127\.0\.0\.1|\[::1\]|0\.0\.0\.0)(:|/|$)")
        full = F.when(has_scheme, raw).when(local, F.concat(F.lit("http://"), raw)).otherwise(
            F.concat(F.lit("https://"), raw)
        )
        scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))

        def check(p: Column) -> Column:
            host = p["host"]
            reason = (
                F.when(raw == "", F.lit("URL is empty."))
                .when(
                    ~scheme.isin("http", "https"),
                    F.concat(F.lit('Unsupported protocol "'), scheme, F.lit(':" (only http/https).')),
                )
                .when(host.isNull(), F.concat(F.lit("Not a parseable URL: "), raw))
                .when(
                    ~host.contains(".") & (host != "localhost"),
                    F.concat(F.lit('Hostname "'), host, F.lit('" does not look like a domain.')),
                )
            )
            url = F.concat(_origin(p), p["path"], _query_suffix(p["query"]))
            return F.struct(
                reason.isNull().alias("ok"),
                F.when(reason.isNull(), url).alias("url"),
                reason.alias("reason"),
            )

        return let(url_parts(full), check)

    return let(F.trim(text_or_empty(c)), build)


# The ways a page number is carried in a URL, strongest first.
PAGE_NUMBER_PATTERNS = (
    (r"(?i)([?&](?:page|paged|pg|pagenum|page_num|pageno|page_number)=)(\d+)", "query"),
    (r"(?i)(/(?:page|pages|p)/)(\d+)", "path"),
    (r"(?i)([?&]p=)(\d+)", "query"),
    (r"(?i)(-page-)(\d+)", "slug"),
    (r"(?i)([?&](?:start|offset|from|skip)=)(\d+)", "offset"),
)


@memo
def page_number(c: Column) -> Column:
    """``struct(number, prefix, kind)`` of the first page-number form in a URL, else null."""
    def build(u: Column) -> Column:
        hit = None
        for pattern, kind in PAGE_NUMBER_PATTERNS:
            made = F.struct(
                F.regexp_extract(u, pattern, 2).cast("decimal(38,0)").cast("bigint").alias("number"),
                F.regexp_extract(u, pattern, 1).alias("prefix"),
                F.lit(kind).alias("kind"),
            )
            hit = F.when(u.rlike(pattern), made) if hit is None else hit.when(u.rlike(pattern), made)
        return hit

    return let(c, build)
