"""Text functions as native Column expressions.

Patterns are written against ASCII word boundaries (``B``) and an explicit whitespace class (``WS``), because
Java's ``\\b`` treats accented letters as word characters and ``\\s`` leaves out the no-break space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

B = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# The same class; ASCII text is told apart by two tests instead of one for each space there is.
WS = rf"[\s[\u0080-\uffff&&[{SPACES}]]]"
NOT_WS = f"[^{SPACES}]"

# fixed values: redaction rules in the order they must run, then typographic replacements
IPV4 = rf"(?<!\w)(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?!\w)"
REDACTIONS = [
    (IPV4, "x.x.x.x"),
    (r"(?i)(?<!\w)[0-9a-f]{32}(?!\w)", "[redacted-flag]"),
    (
        rf"(?i)(?<!\w)(password|passwd|pass|secret|token|api[_-]?key)(?!\w){WS}*[:=]{WS}*[^{SPACES}&]+",
        "$1=[redacted]",
    ),
    (rf"(?i)(?<!\w)Bearer{WS}+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]"),
    (rf"(?<!\w)eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+{B}", "[redacted-jwt]"),
    (rf"(?<!\w)(?:sk|pk|ghp|xox[baprs])[_-][A-Za-z0-9_-]{{10,}}{B}", "[redacted-key]"),
]
SENSITIVE_HEADERS = r"(?i)^\s*(authorization|cookie|set-cookie|x-api-key|x-auth-token|.*-api-key)\s*$"
TYPOGRAPHY = [
    ("[\u2012\u2013\u2014\u2015]", "-"),
    ("[\u2018\u2019\u201a\u201b]", "'"),
    ("[\u201c\u201d\u201e\u201f]", '"'),
    ("\u2026", "..."),
    ("[\u00a0\u2007\u2009\u202f]", " "),
    ("[\u200b\u200c\u200d\ufeff]", ""),
]


def rx(pattern: str) -> str:
    """A rule-table pattern with ASCII word boundaries."""
    return pattern.replace(r"\b", B)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+\\z", "")


def trim_ends(text: Column) -> Column:
    """``trim`` of a column that is at hand: only a text that begins or ends with a space is searched for them."""
    edge = F.substr(text, F.lit(1), F.lit(1)).rlike(WS) | F.right(text, F.lit(1)).rlike(WS)
    return F.when(edge, trim(text)).otherwise(text)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once a row: filters on it stay above the generator, where a projection would let
    each of them compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def tokens(text: Column) -> Column:
    """Whitespace tokens, no empties."""
    return F.filter(F.split(text, f"{WS}+"), lambda t: t != "")


def strip_path(word: Column) -> Column:
    return F.regexp_replace(word, r"^.*[\\/]", "")


def extract_binary(cmd: Column) -> Column:
    """The first word that sets no variable, without its path. A text is cut whole only if it begins with a variable."""
    setting = "^[A-Z_][A-Z0-9_]*="
    first = F.regexp_extract(cmd, f"^{WS}*+({NOT_WS}*+)", 1)
    later = F.get(F.filter(tokens(cmd), lambda t: ~t.rlike(setting)), 0)
    return strip_path(F.coalesce(F.when(first.rlike(setting), later).otherwise(first), F.lit("")))


def mask_ips(text: Column) -> Column:
    return F.regexp_replace(text, IPV4, "x.x.x.x")


def redact_text(text: Column) -> Column:
    for pattern, replacement in REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def redact_headers(headers: Column) -> Column:
    def line(raw: Column) -> Column:
        clean = F.regexp_replace(raw, "\r\\z", "")
        name = F.regexp_extract(clean, r"^([^:]*):", 1)
        hidden = clean.contains(":") & name.rlike(SENSITIVE_HEADERS)
        return F.when(hidden, F.concat(name, F.lit(": [redacted]"))).otherwise(clean)

    return F.array_join(F.transform(F.split(headers, "\n"), line), "\n")


def apply_profile(text: Column, profile: Column | str) -> Column:
    profile = F.lit(profile) if isinstance(profile, str) else profile
    return F.when(profile == "public_safe", redact_text(text)).otherwise(text)


def was_redacted(text: Column) -> Column:
    """Whether redaction changes the text; null text counts as unchanged."""
    return F.coalesce(redact_text(text) != text, F.lit(False))


def normalize_typography(text: Column) -> Column:
    for pattern, replacement in TYPOGRAPHY:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def mask_secret(value: Column) -> Column:
    return F.concat(F.lit("••••"), F.right(value, F.lit(2)))


def rolling_hash(text: Column) -> Column:
    """32-bit ×31 hash over UTF-16 units, as an unsigned bigint."""
    def folded(parts: Column, unit) -> Column:
        return F.aggregate(
            parts, F.lit(0).cast("bigint"), lambda acc, x: (acc * 31 + unit(x)).bitwiseAND(F.lit(0xFFFFFFFF))
        )

    # The text is cut once; a unit of ASCII text is its character. A null counts as empty.
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), 0)
    return F.when(ascii_only, folded(F.split(text, ""), F.ascii)).otherwise(
        folded(units, lambda x: F.conv(x, 16, 10).cast("bigint"))
    )


def hash8(text: Column) -> Column:
    return F.lpad(F.lower(F.hex(rolling_hash(text))), 8, "0")


def hue(text: Column) -> Column:
    return (rolling_hash(text) % 360).cast("int")


def contains_flag(text: Column) -> Column:
    """A maximal run of exactly 32 hex digits."""
    return F.coalesce(text.rlike("(?<![0-9a-fA-F])[0-9a-fA-F]{32}(?![0-9a-fA-F])"), F.lit(False))


def http_method(cmd: Column) -> Column:
    found = F.regexp_extract(cmd, rf"(?i)^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)(?!\w)", 1)
    return F.when(found == "", "GET").otherwise(F.upper(found))


def http_path(cmd: Column) -> Column:
    pattern = rf"(?i)^(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)(?!\w)"
    return F.when(cmd.rlike(pattern), trim(F.regexp_replace(cmd, pattern, ""))).otherwise(cmd)


def url_path(url: Column) -> Column:
    """Path and query of an absolute url; anything else is returned as it is."""
    pattern = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#\s]+"
    rest = F.regexp_replace(F.regexp_replace(url, pattern, ""), r"(?s)#.*\z", "")
    return F.when(
        url.rlike(pattern),
        F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)),
    ).otherwise(url)


def is_web(context: Column) -> Column:
    return F.coalesce(context.startswith("web:"), F.lit(False))


def on_target(context: Column) -> Column:
    return F.coalesce(F.lower(context).contains("ssh:"), F.lit(False))


def ssh_target(cmd: Column) -> Column:
    pattern = (
        rf"(?i)^{WS}*(?:sshpass{WS}+{NOT_WS}+{WS}+)?ssh(?!\w)[^\n]*?(?:{NOT_WS}+@)?"
        rf"(\d{{1,3}}(?:\.\d{{1,3}}){{3}}|[a-z0-9.-]+\.[a-z]{{2,}}|[a-z0-9-]+){WS}*\z"
    )
    return F.when(cmd.rlike(pattern), F.regexp_extract(cmd, pattern, 1))


def wordish(char: Column) -> Column:
    """Whether a text of one character is in [a-z0-9]."""
    return char.between("a", "z") | char.between("0", "9")


def token_contains(haystack: Column, needle: Column, lowered: bool = False) -> Column:
    """Case-insensitive containment whose first occurrence does not cut through a word. ``lowered``: both are in lower case.

    Only the first occurrence is tested at its edges.
    """
    text, word = (haystack, needle) if lowered else (F.lower(haystack), F.lower(needle))
    at = F.position(word, text)
    before = F.when(at > 1, F.substr(text, at - 1, F.lit(1))).otherwise(" ")
    after = F.substr(text, at + F.length(word), F.lit(1))

    cut_left = wordish(F.left(word, F.lit(1))) & wordish(before)
    cut_right = wordish(F.right(word, F.lit(1))) & wordish(after)
    return (at > 0) & ~cut_left & ~cut_right


def seen_terms(text: Column) -> Column:
    words = F.transform(
        F.split(F.lower(text), r"[^\w.-]+"), lambda t: F.regexp_replace(t, r"^[.-]+|[.-]+\z", "")
    )
    return F.array_distinct(F.filter(words, lambda t: F.length(t) >= 3))


def slug(text: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(trim(text)), f"{WS}+", "_"), "[^a-z0-9_]", ""
    )


def coaching_category(text: Column) -> Column:
    from runlens.rules import COACHING_RULES

    label = F.lit("Tactics")
    for pattern, name in reversed(COACHING_RULES):
        label = F.when(text.rlike(rx(pattern)), name).otherwise(label)
    return label


def split_lead(text: Column) -> Column:
    """Struct (action, why): a bold lead, else a short first sentence, else the whole text."""
    bold = rf"(?s)^{WS}*\*\*(.+?)\*\*{WS}*"
    dot = F.instr(text, ". ")
    short = (dot > 1) & (dot < 91)
    action = (
        F.when(text.rlike(bold), trim(F.regexp_extract(text, bold, 1)))
        .when(short, trim(F.substr(text, F.lit(1), dot)))
        .otherwise(trim(text))
    )
    why = (
        F.when(text.rlike(bold), trim(F.regexp_replace(text, bold, "")))
        .when(short, trim(F.substr(text, dot + 2)))
        .otherwise("")
    )
    return F.struct(action.alias("action"), why.alias("why"))


def plain_step(action: Column, why: Column) -> Column:
    return trim(F.regexp_replace(F.concat(action, F.lit(" "), why), r"\*\*|`", ""))


def list_join(items: Column) -> Column:
    """``a, b and c``; empty text for no items."""
    n = F.size(items)
    return F.when(n <= 1, F.coalesce(F.get(items, F.lit(0)), F.lit(""))).otherwise(
        F.concat(
            F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1)
        )
    )
