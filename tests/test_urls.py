import pytest
from pyspark.sql import functions as F

from corpusflow.functions import urls as U


@pytest.mark.parametrize(
    "url, key",
    [
        ("HTTPS://WWW.Example.org:443/a/b/?utm_source=x&id=3&ref=z#f", "https://example.org/a/b?id=3"),
        ("http://example.org/", "http://example.org/"),
        ("https://x.org:80/p", "https://x.org/p"),
        (" not a url ", "not a url"),
        ("https://x.org/a/?UTM_x=1&&b=2", "https://x.org/a?b=2"),
        ("https://x.org?q=1", "https://x.org?q=1"),
        ("https://x.org/a//", "https://x.org/a/"),
    ],
)
def test_normalise_url(one, url, key):
    assert one(U.normalise_url, url) == key
    if "//" not in key[8:]:
        assert one(U.normalise_url, key) == key or key.endswith("/")


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://link.springer.com/a", False),
        ("https://zenodo.org/records/1", True),
        ("https://foo.edu/a", True),
        ("https://example.com/a", False),
        ("nothing", False),
    ],
)
def test_open_access(one, url, expected):
    assert one(U.is_open_access, url) is expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://openstax.org/books/p/pages/preface", False),
        ("https://archive.org/details/foo", True),
        ("https://a.com/x.pdf", True),
        ("https://youtube.com/x.pdf", False),
        ("https://netflix.com/a.pdf", False),
        ("ftp://a.com/x.pdf", False),
        ("https://arxiv.org/ABS/1234", True),
    ],
)
def test_looks_promising(one, url, expected):
    assert one(U.looks_promising, url) is expected


@pytest.mark.parametrize(
    "url, kind, html, expected",
    [
        ("https://a.com/file", "application/octet-stream", False, False),
        ("https://a.com/file.pdf", "application/octet-stream", False, True),
        ("https://a.com/file", "application/pdf; x=1", False, True),
        ("https://a.com/x", "text/html", True, True),
        ("https://a.com/x", "text/html", False, False),
        ("https://archive.org/details/x", "text/html", False, True),
        ("https://a.com/x.pdf", None, False, True),
        ("https://a.com/x", "image/png", True, False),
    ],
)
def test_content_acceptable(one, url, kind, html, expected):
    assert one(lambda u, k: U.content_acceptable(u, k, html), url, kind) is expected


def test_ids(one):
    assert one(U.extract_doi, "https://doi.org/10.1234/abc.def.pdf") == "10.1234/abc.def"
    assert one(U.extract_doi, "see (10.1000/x_1).") == "10.1000/x_1"
    assert one(U.archive_id, "https://archive.org/stream/a%20b/x.txt") == "a b"
    assert one(U.eric_id, "https://files.eric.ed.gov/fulltext/ed123456.pdf") == "ED123456"
    assert one(U.eric_id, "https://archive.org/details/ERIC_EJ1077605") == "EJ1077605"
    assert one(U.eric_id, "https://x.org/EJ1077605") == ""


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("../../../etc/passwd.txt", "passwd.txt"), ("", "upload"), (None, "upload"), (".hidden", "hidden"),
        ("a\\b\\c.txt", "c.txt"), ("dir/", "dir"), ("x" * 300, "x" * 255),
    ],
)
def test_safe_filename(one, raw, expected):
    assert one(U.safe_filename, raw) == expected


def test_storage_suffix(one):
    assert one(U.storage_suffix, "a.TXT") == ".txt"
    assert one(U.storage_suffix, "a.p-f") == ""


def test_identity(one):
    args = dict(schema="u string, x string, p string")
    assert one(U.request_identity, None, "1.1.1.1, 2.2.2.2", "9.9.9.9", **args) == "ip:2.2.2.2"
    assert one(U.request_identity, "7", "1.1.1.1", None, **args) == "user:7"
    assert one(U.request_identity, None, None, None, **args) == "ip:anonymous"


@pytest.mark.parametrize(
    "href, expected",
    [
        ("https://b.org/x", "https://b.org/x"), ("//b.org/x", "https://b.org/x"), ("/x", "https://a.org/x"),
        ("?q=1", "https://a.org/d/p?q=1"), ("f.pdf", "https://a.org/d/f.pdf"), ("../f.pdf", "https://a.org/f.pdf"),
        ("./f.pdf", "https://a.org/d/f.pdf"), ("mailto:x", "mailto:x"),
    ],
)
def test_resolve(one, href, expected):
    assert one(lambda h: U.resolve_href(F.lit("https://a.org/d/p?z=1"), h), href) == expected


def test_object_key(one):
    key = one(U.object_key, "Été à l'Œuvre!", "https://www.x.org/a/")
    assert key.startswith("pdfs/ete-a-l-uvre-") and key.endswith(".pdf") and len(key) == len("pdfs/ete-a-l-uvre-") + 14
    assert key == one(U.object_key, "Été à l'Œuvre!", "https://x.org/a?utm_x=1#t")
    assert one(U.slugify, "!!!") == "document"
