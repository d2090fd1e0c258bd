import hashlib
import random
import re
import time

from placeforge.llm import secrets as S

TOKEN = "9f8A7b6C5d4E3f2G1h0J"


def plain_base(text):
    """The base rules read literally."""
    out = []
    text = text or ""
    kinds = [
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    for rank, (kind, pattern, keep) in enumerate(kinds):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if keep(m)]
    return [x[2] for x in sorted(out)]


def values(text):
    return [text[a:b] for k, a, b, _, _ in S.scan(text) if k == "lexed"]


def test_base_against_plain():
    rng = random.Random(3)
    parts = ["password", "PASSWD", "secret", "toKen", "token", "api_key", "ApiKey", " = ", ":", "=", '"', "'", " ", "\n", "abcdefgh12", "x", "AKIA" + "Q" * 12, "AKIAAKIA", "AKIA1234567", "0123456789abcdef" * 2, "dead", "é", "\U0001f600"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [f"{k}:{a}:{b}" for k, a, b in S.base_spans(text)] == plain_base(text)
    assert S.base_spans("password:token=\"abcdefghij\"") == []


def test_lexer_reads_code_and_configuration():
    assert values(f'db_password = "{TOKEN}"') == [TOKEN]
    assert values(f"privateKey: {TOKEN}") == [TOKEN]
    assert values(f'{{"client_secret": "{TOKEN}"}}') == [TOKEN]
    assert values(f"$auth_token => '{TOKEN}'") == [TOKEN]
    assert values(f"export AWS_SECRET_ACCESS_KEY={TOKEN}") == [TOKEN]


def test_constants_flow_to_sensitive_names():
    assert values(f'k = "{TOKEN}"\nq = k\ndb_pwd = q') == [TOKEN]
    assert values(f'a = "{TOKEN}"\nb = "{TOKEN[::-1]}"\nPASSPHRASE = a + b') == [TOKEN, TOKEN[::-1]]
    assert values(f'colour = "{TOKEN}"\nother = colour') == []


def test_lexer_reads_any_layout():
    for text in [
        f'db_pwd          = "{TOKEN}"', f'{"n" * 94}_pwd="{TOKEN}"', f'pwd = """{TOKEN}"""', f"pwd = '''{TOKEN}'''", f"password:\n    {TOKEN}\nother: 1", f"secret: |\n  {TOKEN}",
        f'set_pwd("{TOKEN}")', f'pwd = [\n  "{TOKEN}"\n]', f"<pwd>{TOKEN}</pwd>", f'signing_secret = K\nK = "{TOKEN}"', f'config["db_pwd"] = "{TOKEN}"', f'x = 1\nx = "{TOKEN}"\npwd = x',
    ]:
        assert values(text) == [TOKEN], text
    assert values(f'pwd = "a\\"{TOKEN}"') == [f'a\\"{TOKEN}']
    assert values('pwd = "AbC12x" + "Yz98Qw"') == ["AbC12x", "Yz98Qw"]
    assert values(f'x = "{TOKEN}"\nx = "plain words"\npwd = x') == []  # the last version before the use


def test_statements_of_a_grammar():
    """Statements whose literals are known to flow to a sensitive name or not, by a plain walk."""
    rng = random.Random(8)
    names = ["db_pwd", "apiSecret", "auth_token", "colour", "shape", "k1", "k2", "k3"]
    for _ in range(300):
        text, lines = "", []
        for _ in range(rng.randint(1, 8)):
            name, refs = rng.choice(names), rng.sample(["k1", "k2", "k3"], rng.randint(0, 2))
            literal = "".join(rng.choice("abcXYZ0123456789QRSTUV") for _ in range(20))
            quote = rng.choice("\"'")
            parts = [r for r in refs if r != name] + ([quote + literal + quote] if rng.random() < 0.7 else [])
            if not parts:
                continue
            text += name + " " * rng.randint(0, 12) + rng.choice(["=", ":", ":=", "=>"]) + " " * rng.randint(0, 12) + " + ".join(parts) + rng.choice(["\n", ";\n", " # note\n"])
            lines.append((name, [p for p in parts if p[0] == "k"], [p.strip(quote) for p in parts if p[0] != "k"]))

        def reaches(k, lines, seen):
            if k in seen:
                return False
            seen.add(k)
            if S.name_score(lines[k][0]) >= 0.9:
                return True
            for j, (_, refs, _) in enumerate(lines):
                if lines[k][0] in refs:
                    before = [i for i in range(j) if lines[i][0] == lines[k][0]]
                    after = [i for i in range(j, len(lines)) if lines[i][0] == lines[k][0]]
                    if k == (before[-1] if before else after[0]) and reaches(j, lines, seen):
                        return True
            return False

        want = [x for k in range(len(lines)) for x in lines[k][2] if reaches(k, lines, set()) and S.literal_score(x) >= 0.4]
        assert values(text) == want, text


def test_long_texts_take_linear_time():
    for part in ("a+", "pwd=[a=[", 'pwd="""', "pwd='", "k=pwd\npwd=k\n", "pwd(", "<pwd>", "pwd ", "+"):
        began = time.perf_counter()
        S.lexed_spans("pwd=" + part * (1_000_000 // len(part)))
        assert time.perf_counter() - began < 10, part


def test_lexer_leaves_harmless_values():
    for text in [f'password_hint = "{TOKEN}"', 'password = "changeme"', 'password = "${PASSWORD}"', 'secret = "two words only here"', "token == value12345", "see https://secret.example.org/abcdefgh", f'colour = "{TOKEN}"', 'token_count = "1234567890"']:
        assert values(text) == [], text


def test_redaction_joins_overlapping_spans():
    text = f'a password = "{"0123456789abcdef" * 2}" b'
    assert S.redact(text, S.scan(text)) == 'a [SECRET]" b'
    assert S.redact(None, []) is None


def test_operator_rows(spark):
    long = "word " * 60_000 + f"token={TOKEN}"
    rows = [(1, f'é😀 password = "{TOKEN}"'), (2, None), (3, ""), (None, "AKIA" + "Z" * 16), (1, f'é😀 password = "{TOKEN}"'), (4, long)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, found int, start string")
    got = S.find_secrets(docs, with_text=True).collect()
    assert len(got) == 6
    for i, text in rows:
        r = next(r for r in got if r.doc_id == i)
        assert r.base_sha256 == hashlib.sha256(",".join(plain_base(text)).encode()).hexdigest()
        assert (r.redacted is None) == (text is None)
        if text:
            assert TOKEN not in r.redacted and "Z" * 16 not in r.redacted
    assert S.find_secrets(docs.limit(0)).count() == 0
