"""URL expressions.

Every function takes and returns a Column, so URL work stays inside whole-stage
code generation.  Parsing follows the WHATWG rules that matter for http(s)
addresses: lower-case host, default port dropped, empty path becomes ``/``, dot
segments resolved, unsafe characters percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webplan.functions.base import let

# Registries whose last two labels act as one public suffix.
TWO_LABEL_SUFFIXES = [
    "co.kr", "or.kr", "go.kr", "ac.kr", "ne.kr", "re.kr", "pe.kr",
    "com.cn", "co.jp", "co.uk", "com.au",
]

# Address patterns that never name a page worth planning.
ASSET_PATTERN = (
    r"(?i)\.(?:css|js|mjs|map|png|jpe?g|gif|svg|webp|ico|woff2?|ttf|eot|mp4|webm|mp3|pdf|zip|gz|xml|json"
    r"|txt|md|markdown|csv|rss|atom|yaml|yml|avif)(?:$|\?)"
)
AUTH_PATTERN = (
    r"(?i)/(?:login|logout|signin|signout|signup|register|oauth|auth/|callback|sso|saml|passport)(?:/|$|\?)"
)
AUTH_HOST_PATTERN = r"(?i)^(?:nid|accounts?|login|auth|sso|passport)\."
SERVICE_PATTERN = (
    r"(?i)/(?:api|_next|static|assets|cdn-cgi|wp-json|graphql|__webpack|node_modules)(?:/|$)"
)
DEFAULT_PAGE_NAME = "페이지"
DEFAULT_BASE = "https://local/"

HTTP_PATTERN = (
    r"(?is)^(https?)://(?:[^/?#@]*@)?([^/?#:@\s]+)(?::(\d*))?([^?#]*)(\?[^#]*)?(#.*)?$"
)
SCHEME_PATTERN = r"(?i)^[a-z][a-z0-9+.\-]*:"
IPV4_PATTERN = r"^\d+\.\d+\.\d+\.\d+$"


SUFFIX_RE = "|".join(x.replace(".", r"\.") for x in TWO_LABEL_SUFFIXES)
ROOT_PATTERN = (
    r"^(?!\d+\.\d+\.\d+\.\d+$)(?:[^.]+\.)*?([^.]+\.(?:" + SUFFIX_RE + r")|[^.]+\.[^.]+)\.?$"
)
PATH_UNSAFE = r'[^\x21-\x7e]|["<>`{}]'
QUERY_UNSAFE = r"""[^\x21-\x7e]|["<>']"""
_SEP = "\x01"


def _encode(c: Column, unsafe: str) -> Column:
    """Percent-encode the characters matched by ``unsafe``; safe strings skip the split."""
    one = lambda ch: (
        F.when(ch == " ", F.lit("%20")).when(ch.rlike(unsafe), F.url_encode(ch)).otherwise(ch)
    )
    return F.when(c.rlike(unsafe), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def _resolve_dots(path: Column) -> Column:
    def step(acc, seg):
        return (
            F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    segs = F.split(path, "/", -1)
    folded = F.array_join(
        F.aggregate(F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0))), F.array(F.lit("")), step), "/"
    )
    closed = F.when(path.rlike(r"/\.{1,2}$"), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), closed).otherwise(path)


def parse(c: Column) -> Column:
    """struct(raw, is_http, is_other, scheme, host, port, path, query, fragment, origin)."""
    t = F.trim(c)
    groups = F.split(F.regexp_replace(t, HTTP_PATTERN, _SEP.join(f"${i}" for i in range(1, 7))), _SEP, -1)

    def fields(p):
        ok = F.size(p) == 6
        part = lambda i: F.when(ok, F.get(p, F.lit(i))).otherwise(F.lit(""))
        scheme, host, port, path = F.lower(part(0)), F.lower(part(1)), part(2), part(3)
        query, fragment = part(4), part(5)
        default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        colon = F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
        clean = let(F.when(path == "", F.lit("/")).otherwise(_resolve_dots(path)), lambda x: _encode(x, PATH_UNSAFE))
        raw = F.when(~ok, F.get(p, F.lit(0)))
        return F.struct(
            raw.alias("raw"),
            ok.alias("is_http"),
            F.coalesce(raw.rlike(SCHEME_PATTERN) & ~raw.rlike(r"(?i)^https?:"), F.lit(False)).alias("is_other"),
            scheme.alias("scheme"), host.alias("host"), colon.alias("port"),
            clean.alias("path"),
            F.when(query == "?", F.lit("")).otherwise(_encode(query, QUERY_UNSAFE)).alias("query"),
            F.when(fragment == "#", F.lit("")).otherwise(_encode(fragment, PATH_UNSAFE)).alias("fragment"),
            F.concat(scheme, F.lit("://"), host, colon).alias("origin"),
        )

    return let(groups, fields)


def with_url(c: Column, body) -> Column:
    """``body(u)`` over the parsed address ``u`` of ``c``."""
    return let(parse(c), body)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(c), HTTP_PATTERN, 2))


def url_path(c: Column) -> Column:
    return with_url(c, lambda u: u["path"])


def strip_www(host: Column) -> Column:
    return F.lower(F.regexp_replace(host, r"(?i)^www\.", ""))


def _drop_one_slash(path: Column) -> Column:
    return F.when(F.length(path) > 1, F.regexp_replace(path, r"/$", "")).otherwise(path)


def _without_fragment(u: Column) -> Column:
    return F.concat(u["origin"], _drop_one_slash(u["path"]), u["query"])


def _normalized(u: Column) -> Column:
    return (
        F.when(u["is_http"], _without_fragment(u))
        .when(u["is_other"], F.regexp_replace(u["raw"], r"#.*$", ""))
        .otherwise(u["raw"])
    )


def normalize_page_url(c: Column) -> Column:
    """Page identity: no fragment, no single trailing slash; unparsable text is only trimmed."""
    return with_url(c, _normalized)


def canonical_link(c: Column) -> Column:
    return with_url(c, lambda u: F.when(u["is_http"], _without_fragment(u)))


def normalize_seed(c: Column) -> Column:
    """struct(seed_url, seed_error): a typed or pasted site address made canonical."""
    bare = F.regexp_replace(F.trim(c), r"/+$", "")
    cleaned = F.regexp_replace(bare, r"[)\],.;]+$", "")
    full = F.regexp_replace(cleaned, r"^(?!(?i:https?://))", "https://")

    def build(u):
        local = (u["host"] == "localhost") | u["host"].rlike(IPV4_PATTERN)
        error = (
            F.when(bare == "", F.lit("url required"))
            .when(~u["is_http"], F.lit("invalid url"))
            .when(~local & ~u["host"].contains("."), F.lit("invalid host"))
        )
        seed = F.concat(u["origin"], _drop_one_slash(u["path"]))
        return F.struct(F.when(error.isNull(), seed).alias("seed_url"), error.alias("seed_error"))

    return with_url(full, build)


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` seen from page ``base`` (still un-normalised text)."""

    def build(v):
        h, b = v["h"], v["b"]
        folder = F.regexp_replace(b["path"], r"[^/]*$", "")
        return (
            F.when(h.rlike(SCHEME_PATTERN), h)
            .when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
            .when(h.startswith("/"), F.concat(b["origin"], h))
            .when(h.startswith("?"), F.concat(b["origin"], b["path"], h))
            .when((h == "") | h.startswith("#"), F.concat(b["origin"], b["path"], b["query"], h))
            .otherwise(F.concat(b["origin"], folder, h))
        )

    return let(F.struct(F.trim(href).alias("h"), parse(base).alias("b")), build)


def is_valid_nav_link(c: Column) -> Column:
    return ~F.trim(F.coalesce(c, F.lit(""))).rlike(r"(?i)^($|#|javascript:)")


def nav_path(href: Column, base: Column | None = None) -> Column:
    """host + path + query used to compare destinations; '' when the link goes nowhere."""
    full = resolve_url(href, F.lit(DEFAULT_BASE) if base is None else base)
    target = lambda u: (
        F.when(u["is_http"], F.concat(strip_www(u["host"]), u["path"], u["query"]))
        .when(u["is_other"], F.regexp_extract(u["raw"], r"(?i)^[a-z][a-z0-9+.\-]*:([^#]*)", 1))
        .otherwise(F.trim(F.regexp_replace(href, r"#.*$", "")))
    )
    return F.when(is_valid_nav_link(href), with_url(full, target)).otherwise(F.lit(""))


def clean_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^\.", ""), r"^www\.", "")


def root_domain(host: Column) -> Column:
    """Registrable domain: last two labels, or three under a two-label suffix."""
    return F.regexp_replace(clean_host(host), ROOT_PATTERN, "$1")


def site_of(url: Column) -> Column:
    return root_domain(url_host(url))


def viewport_of(url: Column) -> Column:
    return F.when(url_host(url).startswith("m."), F.lit("mo")).otherwise(F.lit("pc"))


def same_site_family(a: Column, b: Column) -> Column:
    ra, rb = root_domain(a), root_domain(b)
    return (ra != "") & (ra == rb)


def page_context(url: Column, title: Column, referrer: Column | None = None) -> Column:
    """struct(page_location, page_path, page_title, page_referrer)."""
    trimmed = lambda x: F.trim(F.coalesce(x, F.lit("")))

    def build(u):
        tail = F.concat(u["path"], u["query"], u["fragment"])
        location = F.when(u["is_http"], F.concat(u["origin"], tail)).otherwise(u["raw"])
        path = F.when(u["is_http"], tail).otherwise(F.regexp_replace(u["raw"], "^(?!/)", "/"))
        return F.struct(
            location.alias("page_location"), path.alias("page_path"), trimmed(title).alias("page_title"),
            trimmed(referrer if referrer is not None else F.lit("")).alias("page_referrer"),
        )

    return with_url(url, build)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def path_depth(url: Column) -> Column:
    return with_url(url, lambda u: F.when(u["is_http"], F.size(_segments(u["path"]))).otherwise(F.lit(99)))


def _apex_or_www(host: Column) -> Column:
    return strip_www(host) == root_domain(host)


def _moved(u: Column, seed: Column) -> Column:
    onto = F.concat(u["scheme"], F.lit("://"), seed, u["port"], _drop_one_slash(u["path"]), u["query"])
    return (
        F.when(u["is_http"] & (u["host"] == seed), _without_fragment(u))
        .when(u["is_http"] & (root_domain(u["host"]) == root_domain(seed)) & _apex_or_www(u["host"]), onto)
    )


def rewrite_onto_seed_host(url: Column, seed_host: Column) -> Column:
    """Move an apex/www address of the same site onto the seed's host; null when not movable."""
    return with_url(url, lambda u: _moved(u, F.lower(seed_host)))


def resolve_link(href: Column, base: Column) -> Column:
    """Destination relative to the page: path+query on the same origin, full address elsewhere."""
    h = F.trim(F.coalesce(href, F.lit("")))

    def build(v):
        u = v["u"]
        local = F.concat(u["path"], u["query"])
        return (
            F.when(v["h"].rlike(r"(?i)^($|#$|javascript:)"), F.lit(None).cast("string"))
            .when(u["is_http"] & (u["origin"] == v["o"]), local)
            .when(u["is_http"], F.concat(u["origin"], local))
            .otherwise(v["h"])
        )

    origin = with_url(base, lambda b: b["origin"])
    return let(F.struct(h.alias("h"), parse(resolve_url(h, base)).alias("u"), origin.alias("o")), build)


def host_key(c: Column) -> Column:
    return with_url(c, lambda u: F.when(
        u["is_http"], F.regexp_replace(F.concat(u["host"], u["port"]), r"^www\.", "")
    ).otherwise(F.lower(u["raw"])))


def locale_hint(url: Column) -> Column:
    return F.when(
        url_host(url).endswith(".kr"),
        F.struct(
            F.lit("KR").alias("country"),
            F.array(*[F.lit(x) for x in ("ko-KR", "ko", "en")]).alias("languages"),
        ),
    )


def _decode(c: Column) -> Column:
    """Percent-decoding that leaves malformed or non UTF-8 sequences as they are."""
    return let(
        F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")),
        lambda plain: F.when(plain.isNull() | plain.contains("\ufffd"), c).otherwise(plain),
    )


def _blank_null(c: Column) -> Column:
    return F.when(c != "", c)


def page_name(og_title: Column, title: Column, url: Column) -> Column:
    meta = F.trim(F.coalesce(_blank_null(og_title), title, F.lit("")))

    def from_url(u):
        segs = _segments(u["path"])
        return (
            F.when(u["is_http"] & (F.size(segs) > 0), _decode(F.element_at(segs, -1)))
            .when(u["is_http"], F.regexp_replace(u["host"], r"^www\.", ""))
            .otherwise(u["raw"])
        )

    return F.substring(F.when(F.length(meta) >= 2, meta).otherwise(with_url(url, from_url)), 1, 80)


def page_category_hint(title: Column, url: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    cleaned = F.trim(
        F.regexp_replace(F.regexp_replace(t, r"\s*[|\-–—]\s*.+$", ""), r"\s*-\s*.+$", "")
    )
    segs = _segments(url_path(url))
    last = let(segs, lambda s: F.regexp_replace(_decode(F.when(F.size(s) > 0, F.element_at(s, -1))), r"[-_]+", " "))
    return (
        F.when((t != "") & F.length(cleaned).between(2, 40), cleaned)
        .otherwise(let(last, lambda x: F.when(F.length(x) >= 2, F.substring(x, 1, 40))
                       .otherwise(F.lit(DEFAULT_PAGE_NAME))))
    )


def capture_job_id(url: Column) -> Column:
    return _blank_null(F.regexp_extract(url, r"/captures/([^/]+)/", 1))


def _keep(u: Column, seed_root: Column, seed_host: Column | None, subdomains: bool) -> Column:
    ok = (
        u["is_http"]
        & (root_domain(u["host"]) == seed_root)
        & ~u["host"].rlike(AUTH_HOST_PATTERN)
        & ~u["path"].rlike(ASSET_PATTERN)
        & ~u["path"].rlike(SERVICE_PATTERN)
        & ~F.concat(u["path"], u["query"]).rlike(AUTH_PATTERN)
    )
    if not subdomains and seed_host is not None:
        ok = ok & (strip_www(u["host"]) == strip_www(seed_host))
    return F.coalesce(ok, F.lit(False))


def keep_url(url: Column, seed_root: Column, seed_host: Column | None = None, subdomains: bool = True) -> Column:
    """Is the address a page of the seed's site (not an asset, service or sign-in address)?"""
    return F.coalesce(with_url(url, lambda u: _keep(u, seed_root, seed_host, subdomains)), F.lit(False))


def keep_or_rewrite(url: Column, seed_root: Column, seed_host: Column) -> Column:
    """The address to keep on the seed's host, moved there when it is the site's apex or www
    address; null when it is filtered out."""

    def moved_and_kept(m):
        return F.when(m.isNotNull() & keep_url(m, seed_root, seed_host, False), m)

    def build(u):
        return F.when(_keep(u, seed_root, seed_host, False), _without_fragment(u)).otherwise(
            let(_moved(u, F.lower(seed_host)), moved_and_kept)
        )

    return with_url(url, build)
