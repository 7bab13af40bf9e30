"""Column functions, and the engine's defined samples."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as X
from lodestone.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokenize(spark):
    assert one(spark, X.tokenize(F.lit("handleFailure(err): HTTPServer_v2 a"))) == ["handle", "failure", "err", "server", "v2"]


@pytest.mark.parametrize(("text", "want"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n\n", ["a", "b", ""]), ("\n", [""]), ("a\rb", ["a\rb"])])
def test_lines(spark, text, want):
    assert one(spark, X.lines(F.lit(text))) == want


def test_query_tokens(spark):
    got = one(spark, X.query_tokens(F.lit("Where are failed payments handled?")))
    assert got == sorted(got) and {"fail", "failure", "retry", "pay", "stripe", "transaction", "paym", "payments"} <= set(got)


def test_snippet(spark):
    lines = X.lines(F.lit("a\nb\nc\nd\ne"))
    assert one(spark, X.snippet(lines, F.lit(2), F.lit(4))) == "b\nc\nd"
    long = X.lines(F.lit("\n".join(["x" * 40] * 200)))
    assert len(one(spark, X.snippet(long, F.lit(1), F.lit(200)))) == 2500


def test_secrets(spark):
    for text in ("-----BEGIN PRIVATE KEY-----", "aws_secret_access_key: x", "api_key=1", "Password=2"):
        assert one(spark, X.looks_like_secret(F.lit(text)))
    assert not one(spark, X.looks_like_secret(F.lit("const x = password.length")))
    assert one(spark, X.redact_secrets(F.lit("a\nAPI_KEY=abc\nPRIVATE_KEY: z\nPRIVATE_KEY\nb"))) == "a\nAPI_KEY=[REDACTED]\nPRIVATE_KEY: [REDACTED]\n[REDACTED]\nb"


@pytest.mark.parametrize(("path", "want"), [(".env", True), ("config/.env.local", True), ("certs/prod.pem", True), ("secrets/token", True), ("src/auth/session.ts", False), ("environment.ts", False), ("a\\secrets\\b", True)])
def test_sensitive_paths(spark, path, want):
    assert one(spark, P.is_sensitive(F.lit(path))) is want


@pytest.mark.parametrize(
    ("path", "layer"),
    [
        ("src/services/AuthService.ts", "services"), ("src/db/UserRepository.ts", "repositories"), ("src/db/pool.ts", "database"), ("src/api/session.ts", "api"),
        ("app/page.tsx", "pages"), ("src/workers/sync.py", "workers"), ("src/components/A.tsx", "components"), ("src/hooks/useAuth.ts", "hooks"),
        ("src/clients/stripe.ts", "external"), ("src/main.rs", "other"), ("SRC/API/x.ts", "api"), ("src/apis/x.ts", "other"),
    ],
)
def test_layers(spark, path, layer):
    assert one(spark, P.layer(F.lit(path))) == layer


def test_paths(spark):
    assert one(spark, P.normalize(F.lit("/a/./b/../c//d"))) == "a/c/d"
    assert one(spark, P.normalize(F.lit("../../x"))) == "x"
    found = one(spark, P.module_candidates(F.lit("src/a/x.ts"), F.lit("../b.c")))
    assert found[0] == "src/b.ts" and found[6] == "src/b.c/index.ts" and found[-1] == "src/b.c" and len(found) == 11
    assert one(spark, P.module_candidates(F.lit("src/a/x.ts"), F.lit("react"))) == []
    for path, want in (("src/a.test.ts", True), ("tests/x.py", False), ("src/tests/x.py", True), ("fixtures/test_a.py", True), ("src/fixtures/a.test.ts", False), ("a_test.rs", True), ("test_a.py", True), ("tests/fixtures/a.ts", False), ("src/latest/x.ts", False)):
        assert one(spark, P.is_test(F.lit(path))) is want, path
    for path, want in (("src/routes/a.ts", True), ("src/api/a.ts", True), ("app/layout.tsx", True), ("src/router.ts", False)):
        assert one(spark, P.is_route(F.lit(path))) is want, path
    for path, want in (("a/b.ts", True), ("", False), ("/a", False), ("a/../b", False), ("secrets/x", False)):
        assert one(spark, P.is_valid_content_path(F.lit(path))) is want, path


def test_uuid5(spark):
    for name in ("src/a.ts", "é", ""):
        assert one(spark, X.uuid5(F.lit(str(uuid.NAMESPACE_URL)), F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


@pytest.mark.parametrize(
    ("question", "intent"),
    [("Which files change most often?", "evolution"), ("Where is the login?", "locate"), ("What breaks if I edit it?", "impact"), ("How does it work?", "explain"), ("payments", "search")],
)
def test_intents(spark, question, intent):
    assert one(spark, X.detect_intent(F.lit(question))) == intent


def test_markers_and_inflection(spark):
    cited = F.array(F.struct(F.lit("KEY").alias("key"), F.lit("src/a.ts:18-42").alias("place")))
    assert one(spark, X.resolve_markers(F.lit("See [citation:KEY]"), cited)) == "See src/a.ts:18-42"
    assert [one(spark, X.inflect(F.lit(v))) for v in ("process", "retry", "fetch", "load")] == ["Processes", "Retries", "Fetches", "Loads"]
    assert one(spark, X.repo_name(F.lit("git@host:me/tool.git/"))) == "tool"


def test_handles(spark):
    assert one(spark, X.handles(F.lit("// retries it\nx\n# ab\n// retries it\n  // and more"))) == ["retries it", "and more"]
    assert one(spark, X.handles(F.lit("retryPayment(); sessionAuth(); notifyAll()"))) == ["notify", "retry", "session"]


def test_buckets_are_fnv(spark):
    def fnv(token: str) -> int:
        h = 0xCBF29CE484222325
        for b in token.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h % 256

    for token in ("a", "payment", "v2", "authentication"):
        assert one(spark, V.bucket(F.lit(token))) == V.fnv1a_bucket(token) == fnv(token)


def test_cosine(spark):
    text = "failed payment retry retry"
    counts: dict[int, int] = {}
    for token in text.split():
        counts[V.fnv1a_bucket(token)] = counts.get(V.fnv1a_bucket(token), 0) + 1
    assert one(spark, V.cosine_with(V.sparse(F.lit(text)), counts)) == pytest.approx(1)
    assert one(spark, V.cosine_with(V.sparse(F.lit("")), counts)) == 0
    pay, auth = (one(spark, V.cosine_with(V.sparse(F.lit(t)), counts)) for t in ("retry the failed payment", "login with a session"))
    assert pay > auth
    assert one(spark, V.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0


def test_purpose_and_flow(spark):
    def said(name, kind, text):
        return one(spark, X.purpose(F.lit(name), F.lit(kind), F.lit(text)))

    assert said("handlePayment", "function", "  // Validates it all\nexport function x() {}") == "Validates it all"
    assert said("handlePayment", "function", "# ab\nfunction x() {\n// inside (never)") == "Handles a payment." == said("handlePayment", "method", "")
    assert [said(n, "function", "") for n in ("watch", "applyFix", "run", "_")] == ["Watches this unit of work.", "Applies a fix.", "Runs this unit of work.", "The function _."]
    assert said("StripeClient", "class", "class StripeClient {}") == "Defines StripeClient." and said("MAX", "constant", "") == "The constant MAX."
    text = "function a() {\n  // first step\n  /// second\n * third one\n  # no\n}"
    assert one(spark, X.flow(F.lit(text), F.array(F.lit("b")))) == ["first step", "second", "third one"]
    assert one(spark, X.flow(F.lit("x()"), F.array(F.lit("b"), F.lit("c")))) == ["Calls b", "Calls c"]
    whole = one(spark, X.explanation(F.lit("P."), F.array(F.lit("s")), F.array(F.lit("d"))))
    assert whole == "Purpose\nP.\n\nFlow\n1. s\n\nDependencies\n\u2192 d\n"


def test_sparse_vectors(spark):
    text = "payPal retry RETRY x 7 é2e HTTPServer_v2"
    tokens = ["pay", "pal", "retry", "server", "v2", "2e"] + ["retry"] * 1
    from collections import Counter

    want = Counter(V.fnv1a_bucket(t, 64) for t in one(spark, X.tokenize(F.lit(text))))
    got = one(spark, V.sparse(F.lit(text), 64))
    assert {e.bucket: e.n for e in got.entries} == dict(want) and got.ss == sum(n * n for n in want.values())
    assert set(tokens) <= set(one(spark, X.tokenize(F.lit(text))))
    assert one(spark, V.sparse(F.lit(None).cast("string"))).entries == []
