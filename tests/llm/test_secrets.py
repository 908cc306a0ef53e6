"""The patterns against brute force, the lexer by planted cases, and its time on long texts."""

import hashlib
import random
import time

import pytest

from axlewatch.llm import secret_scan

KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def slow_assign(text):
    """Leftmost matches by hand, in the order of the pattern's own choices."""
    out, i = [], 0
    while i < len(text):
        for k in KEYS:
            if text[i : i + len(k)].lower() != k:
                continue
            hit = None
            for q1 in (1, 0):
                j = i + len(k)
                if q1 and not (j < len(text) and text[j] in "\"'"):
                    continue
                j += q1
                while j < len(text) and text[j] == " ":
                    j += 1
                if j >= len(text) or text[j] not in ":=":
                    continue
                j += 1
                while j < len(text) and text[j] == " ":
                    j += 1
                if j < len(text) and text[j] in "\"'":
                    j += 1
                e = j
                while e < len(text) and text[e] in VALUE:
                    e += 1
                if e > j:
                    hit = (j, e)
                    break
            if hit:
                if hit[1] - hit[0] >= 6:
                    out.append(("assign", i, hit[1]))
                i = hit[1] - 1
                break
        i += 1
    return out


def slow_runs(kind, text, first, alphabet, least):
    out, i = [], 0
    while i < len(text):
        if text.startswith(first, i) and (first or text[i] in alphabet):
            e = i + len(first)
            while e < len(text) and text[e] in alphabet:
                e += 1
            if e > i + len(first):
                if e - i >= least:
                    out.append((kind, i, e))
                i = e
                continue
        i += 1
    return out


def test_patterns_against_brute_force():
    r = random.Random(4)
    parts = [*KEYS, "PassWord", "tokensecret", "=", ":", " ", "  ", '"', "'", "abc", "A1+/", "_.=-", "AKIA", "AKIA" + "Z9" * 9, "0123456789abcdef", "deadbeef", "é", "\n", "\t", "ABCDEF"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(0, 14)))
        upper, lower = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), set("0123456789abcdef")
        want = slow_assign(text) + slow_runs("access", text, "AKIA", upper, 20) + slow_runs("hex", text, "", lower, 24)
        assert secret_scan.base_spans(text) == sorted(want, key=lambda x: (x[1], secret_scan.KINDS.index(x[0]))), text


FOUND = [
    ('db_password = "hQ9zRk3Lw8Vt2"', ["hQ9zRk3Lw8Vt2"]),
    ('let dbPassword: string = "hQ9zRk3Lw8Vt2";', ["hQ9zRk3Lw8Vt2"]),
    ('var clientSecret string = "hQ9zRk3Lw8Vt2"', ["hQ9zRk3Lw8Vt2"]),
    ('k = "hQ9zRk3Lw8Vt2"\nDB_PWD := k', ["hQ9zRk3Lw8Vt2"]),
    ('a = "hQ9zRk3Lw8Vt2"\nb = a\nc = b\nprivate_key: c', ["hQ9zRk3Lw8Vt2"]),
    ('DB_PWD = "hQ9z" + "Rk3L" + "w8Vt2x"', ["hQ9z", "Rk3L", "w8Vt2x"]),
    ('x = "hQ9z"\ny = "Rk3Lw8Vt"\npwd = x + y', ["hQ9z", "Rk3Lw8Vt"]),
    ('{"auth_token": "hQ9zRk3Lw8Vt2"}', ["hQ9zRk3Lw8Vt2"]),
    ("--db-password=hQ9zRk3Lw8Vt2", ["hQ9zRk3Lw8Vt2"]),
    ('password = "changeme"', []),
    ('title = "hQ9zRk3Lw8Vt2"', []),
    ('password = "a plain sentence of words"', []),
    ('pwd = pwd + "x"', []),
    ("a = b\nb = a\npassword = a", []),
]


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_lexer_follows_names(text, want):
    assert [text[a:b] for k, a, b in secret_scan.scan(text)[1] if k == "lexed"] == want


K = "hQ9zRk3Lw8Vt2"
SYNTAX = [
    (f'os.environ["DB_PASSWORD"] = "{K}"', [K]),
    (f"cfg['api_secret'] = '{K}'", [K]),
    (f'pwd = f"{K}"', [K]),
    (f'pwd = b"{K}"', [K]),
    (f'pwd = """{K}"""', [K]),
    (f"pwd = `{K}`", [K]),
    (f'pwd, x = "{K}", 1', [K]),
    (f'x, pwd = 1, "{K}"', [K]),
    (f'#define PWD "{K}"', [K]),
    (f"<pwd>{K}</pwd>", [K]),
    (f'<db:pwd kind="a"> {K} </db:pwd>', [K]),
    (f"pwd: |\n  {K}\nnext: 1", [K]),
    (f"a:\n  private_key: |-\n    {K}\n    {K[::-1]}\n  b: 1", [f"{K}\n    {K[::-1]}"]),
    (f'conn.setPassphrase("{K}")', [K]),
    (f'props.put("api_secret", "{K}")', [K]),
    (f"run --pwd {K} --user me", [K]),
    (f"connect(user='me', pwd='{K}')", [K]),
    ('password = "correct horse battery staple"', ["correct horse battery staple"]),
    ("the pwd: Constantinople was", []),
    ("pwd: Constantinople", ["Constantinople"]),
    (f"the pwd: {K} was", [K]),
    (f"it's said that pwd = '{K}' isn't good", [K]),
    ('password = "Enter your password here"', []),
    ('pwd = f"{value}-{other}"', []),
    ("we set a secret, then a token, then the pwd of our connection", []),
    ('setTitle("hQ9zRk3Lw8Vt2")', []),
    ('pwd, x = f(1), 2', []),
]


@pytest.mark.parametrize(("text", "want"), SYNTAX)
def test_lexer_reads_the_forms_of_pairs(text, want):
    assert [text[a:b] for k, a, b in secret_scan.scan(text)[1] if k == "lexed"] == want


@pytest.mark.parametrize("text", [f'pwd = "{"x" * 9}\\" + k', "pwd: |", "<pwd>", "<pwd></pwd>", "a[", 'cfg["pwd"]', "--pwd", "#define pwd", "pwd,", "pwd, x =", "set_pwd(", 'put("pwd", ', "pwd: a<", "\\", "pwd = \\"])
def test_torn_syntax_has_no_spans(text):
    assert [x for x in secret_scan.scan(text)[1] if x[0] == "lexed"] == []


def test_lexer_finds_what_patterns_miss_and_reports_what_they_find(spark):
    rows = [(i, t) for i, (t, _) in enumerate(FOUND)] + [(99, None), (98, "")]
    got = {r.doc_id: r for r in secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted = [i for i, (_, want) in enumerate(FOUND) if want]
    assert sum("lexed" in got[i].spans for i in planted) == len(planted) > sum(got[i].n_assign > 0 for i in planted)
    assert got[0].n_assign == 1 and got[0].spans.count(",") == 1  # both report it
    assert got[99].spans == got[98].spans == "" and got[99].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_doubling_sums_stay_small():
    text = "\n".join(f"a{i} = a{i + 1} + a{i + 1}" for i in range(60)) + '\na60 = "hQ9zRk3Lw8Vt2"\npassword = a0'
    assert [text[a:b] for k, a, b in secret_scan.scan(text)[1] if k == "lexed"] == ["hQ9zRk3Lw8Vt2"]


@pytest.mark.parametrize(
    "text",
    ["secret: x " + "a-" * 500_000, "".join(f"k = \"v{i}hQ9zRk3Lw8\"\npassword_{i} = k\n" for i in range(30_000)), "secret " + " " * 1_000_000, "secret=" * 150_000, 'pwd = "' + "\\x" * 500_000, "a=" + "b+" * 500_000, "a" * 1_000_000 + " secret", "\n".join(f"n{i} = n{i + 1}" for i in range(50_000)) + "\npassword = n0",
        "pwd = " + "?a=" * 300_000, "pwd " + "a, " * 300_000, 'pwd "' + '\\"' * 500_000, 'pwd ' + '"""' + 'x""' * 300_000, "pwd " + "<a>" * 300_000, "pwd: |\n" * 100_000, "pwd " + "k: t<" * 200_000, "pwd " + "'" * 500_001, "pwd: x " * 100_000],
    ids=["hyphens", "constants", "spaces", "keys", "escapes", "sum", "word", "chain", "marks", "names", "open", "triple", "elements", "blocks", "types", "ticks", "line"],
)
def test_a_long_text_takes_seconds(text):
    began = time.process_time()
    secret_scan.scan(text)
    assert time.process_time() - began < 6
