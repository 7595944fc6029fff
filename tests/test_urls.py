import pytest
from pyspark.sql import functions as F

from webplan.functions import urls as U

L = F.lit


@pytest.mark.parametrize("raw, want", [
    ("https://A.com/x/?q=1#f", "https://a.com/x?q=1"), ("https://a.com", "https://a.com/"), ("https://a.com/#x", "https://a.com/"),
    ("  not a url ", "not a url"), ("mailto:a@b#c", "mailto:a@b"), ("http://a.com:80/b/../c/", "http://a.com/c"),
    ("https://a.com/für me", "https://a.com/f%C3%BCr%20me"),
])
def test_normalize_page_url(one, raw, want):
    assert one(U.normalize_page_url(L(raw))) == want


def test_canonical_link_needs_http(one):
    assert one(U.canonical_link(L("mailto:a@b"))) is None
    assert one(U.canonical_link(L("https://a.com/b/"))) == "https://a.com/b"


@pytest.mark.parametrize("raw, url, error", [
    ("shop.example.kr).", "https://shop.example.kr/", None), ("localhost", "https://localhost/", None), ("10.0.0.1/x/?q", "https://10.0.0.1/x", None),
    ("nohost", None, "invalid host"), (" / ", None, "url required"), ("http://a.com/b/#c", "http://a.com/b", None),
])
def test_normalize_seed(one, raw, url, error):
    got = one(U.normalize_seed(L(raw)))
    assert (got["seed_url"], got["seed_error"]) == (url, error)


@pytest.mark.parametrize("host, root", [
    ("a.b.co.kr", "b.co.kr"), ("www.x.co.uk", "x.co.uk"), ("x.com.jp", "com.jp"), ("10.1.2.3", "10.1.2.3"), (".mail.a.com", "a.com"),
    ("localhost", "localhost"), ("a.com", "a.com"), ("co.kr", "co.kr"),
])
def test_root_domain(one, host, root):
    assert one(U.root_domain(L(host))) == root


@pytest.mark.parametrize("url, keep", [
    ("https://a.com/x", True), ("https://a.com/i.png", False), ("https://a.com/api/v1", False), ("https://a.com/login", False),
    ("https://a.com/p?to=/login", False), ("https://a.com/auth/x", True), ("https://a.com/auth//x", False), ("https://b.com/x", False),
    ("https://login.a.com/x", False), ("ftp://a.com/x", False), ("https://m.a.com/x", True),
])
def test_keep_url(one, url, keep):
    assert one(U.keep_url(L(url), L("a.com"))) is keep


def test_rewrite_only_apex_or_www(one):
    assert one(U.rewrite_onto_seed_host(L("https://www.a.com/x/"), L("dev.a.com"))) == "https://dev.a.com/x"
    assert one(U.rewrite_onto_seed_host(L("https://blog.a.com/x"), L("dev.a.com"))) is None
    assert one(U.keep_or_rewrite(L("https://a.com/x"), L("a.com"), L("dev.a.com"))) == "https://dev.a.com/x"


def test_links_resolve(one):
    base = L("https://www.a.com/d/e?x=1")
    assert one(U.resolve_link(L("f?y"), base)) == "/d/f?y"
    assert one(U.resolve_link(L("../g"), base)) == "/g"
    assert one(U.resolve_link(L("//b.com/h#z"), base)) == "https://b.com/h"
    assert one(U.resolve_link(L("#"), base)) is None
    assert one(U.resolve_link(L("#z"), base)) == "/d/e?x=1"
    assert one(U.nav_path(L("/p?q=1#z"), base)) == "a.com/p?q=1"
    assert one(U.nav_path(L("javascript:x"), base)) == ""


def test_names(one):
    assert one(U.page_name(L(""), L("T"), L("https://www.a.com/%EC%B6%94%EC%B2%9C"))) == "추천"
    assert one(U.page_name(L(""), L(""), L("https://www.a.com/%EC%B6"))) == "%EC%B6"
    assert one(U.page_category_hint(L("Home | Shop"), L("https://a.com/x"))) == "Home"
    assert one(U.page_category_hint(L(""), L("https://a.com/my-new_page"))) == "my new page"
    assert one(U.page_category_hint(L(""), L("https://a.com/"))) == "페이지"
    assert one(U.path_depth(L("x"))) == 99
