"""Version orderings as order-preserving keys.

key(a) < key(b) exactly where the ecosystem orders a before b; a null key means that the string is no version there.
Six orderings are SQL expressions, so ranges compare inside generated code; two (gem, composer) are keys computed over
Arrow batches. Maven's order depends on both sides: versions of numbers and at most one qualifier have a SQL key, and
others are compared pairwise.

Versions come from images and lockfiles that nobody vouches for, and may be of any length: patterns repeat groups
possessively, so that matching neither recurses nor tries again, and Maven's nesting is walked in loops.

Keys are strings compared by bytes. A number is the length of its length, its length, and its digits without leading
zeros, so it may have any length. "!" ends a list or a word, as it sorts below every character that a word may have.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

MAX_LENGTH = 256
#: Ecosystem family -> comparer; families with a release after a colon are listed by their family alone.
FAMILIES = {
    "semver": ["Go", "npm", "crates.io"],
    "pep440": ["PyPI"],
    "apk": ["Alpine", "Wolfi", "Chainguard"],
    "deb": ["Debian", "Ubuntu"],
    "rpm": ["Red Hat", "Rocky Linux", "AlmaLinux", "Amazon Linux", "Oracle Linux", "Fedora", "SLES", "openSUSE Leap"],
    "gem": ["RubyGems"],
    "nuget": ["NuGet"],
    "composer": ["Packagist"],
    "maven": ["Maven"],
}
#: Fixed value: the Ubuntu keys that are compared and stored; all others name lines of their own.
MAINLINE_UBUNTU = "^Ubuntu:[0-9]{2}[.][0-9]{2}(:LTS)?$"
NEEDS_RELEASE = {"Alpine", "Debian", "Ubuntu", "Red Hat", "Rocky Linux", "AlmaLinux", "Amazon Linux", "Oracle Linux", "Fedora", "SLES", "openSUSE Leap"}


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _num(s: str) -> str:
    d = f"regexp_replace({s}, '^0+', '')"
    return f"concat(length(cast(length({d}) as string)), length({d}), {d})"


def _group(v: str, pattern: str, n: int) -> str:
    return f"regexp_extract({v}, {_q(pattern)}, {n})"


def _let(value: str, name: str, body: str) -> str:
    """SQL of body with name bound to value, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _groups(v: str, pattern: str, n: int) -> str:
    """SQL of an array of the whole string and the n groups of a pattern that has to match all of it, from one pass;
    null where it doesn't match."""
    marked = "".join(f"\x01${i}" for i in range(1, n + 1))
    split = _let(f"split(regexp_replace({v}, {_q(pattern)}, '{marked}'), '\x01')", "q", f"case when size(q) = {n + 1} then q end")
    return f"case when not contains({v}, '\x01') then {split} end"


_PRE = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
_SEMVER = rf"^v?([0-9]+\.[0-9]+\.[0-9]+)(?:-({_PRE}(?:\.{_PRE})*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?\z"
_SEMVER_SHORT = r"^v?(?!0\z)((?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*))?)\z"
_SEMVER_ANY = f"(?:{_SEMVER}|{_SEMVER_SHORT})"
_SEMVER_PLAIN = r"^[0-9]{1,9}\.[0-9]{1,9}\.[0-9]{1,9}\z"


def semver_key(v: str) -> str:
    parts = "split(g[1] || g[3], '[.]')"
    numbers = ", ".join(_num(f"coalesce(get(p, {i}), '0')") for i in range(3))
    ids = f"array_join(transform(split(g[2], '[.]'), i -> case when i rlike '^[0-9]+\\\\z' then concat('1', {_num('i')}) else concat('2', i, '!') end), '')"
    key = _let(parts, "p", f"concat({numbers}, case when g[2] = '' then '~' else concat({ids}, '!') end)")
    # Three short numbers are what most versions are: their key needs neither lambdas nor groups.
    places = (f"substring_index({v}, '.', 1)", f"substring_index(substring_index({v}, '.', 2), '.', -1)", f"substring_index({v}, '.', -1)")
    digits = [f"trim(LEADING '0' FROM {x})" for x in places]
    plain = "concat(" + ", ".join(f"'1', length({d}), {d}" for d in digits) + ", '~')"
    return f"case when {v} rlike {_q(_SEMVER_PLAIN)} then {plain} when length({v}) <= {MAX_LENGTH} then {_let(_groups(v, _SEMVER_ANY, 3), 'g', f'case when g is not null then {key} end')} end"


#: Fixed value: the grammar of PEP 440.
_PEP440 = (
    r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)([._-]?(alpha|a|beta|b|preview|pre|c|rc)[._-]?([0-9]+)?)?"
    r"((?:-([0-9]+))|(?:[._-]?(?:post|rev|r)[._-]?([0-9]+)?))?([._-]?dev[._-]?([0-9]+)?)?(?:\+([a-z0-9]+(?:[._-][a-z0-9]+)*))?\z"
)


def pep440_key(v: str) -> str:
    t = f"lower(trim(BOTH ' \\t\\n\\r\\f' FROM {v}))"
    release = _let("regexp_replace(g[2], '(?:(?:^|[.])0+)+\\\\z', '')", "r", f"case when r = '' then '' else array_join(transform(split(r, '[.]'), i -> concat('a', {_num('i')})), '') end")
    pre = "case when g[3] <> '' then case when g[4] in ('a', 'alpha') then '1' when g[4] in ('b', 'beta') then '2' else '3' end when g[9] <> '' and g[6] = '' then '0' else '4' end"
    post = f"case when g[6] = '' then '0' else '1' end, {_num('concat(g[7], g[8])')}"
    dev = f"case when g[9] = '' then '1' else '0' end, {_num('g[10]')}"
    local = f"case when g[11] = '' then '' else concat('1', array_join(transform(split(g[11], '[._-]'), i -> case when i rlike '^[0-9]+\\\\z' then concat('2', {_num('i')}) else concat('1', i, '!') end), ''), '!') end"
    key = f"concat({_num('g[1]')}, {release}, '!', {pre}, {_num('g[5]')}, {post}, {dev}, {local})"
    return f"case when length({v}) <= {MAX_LENGTH} then {_let(_groups(t, _PEP440, 11), 'g', f'case when g is not null then {key} end')} end"


_DEB = r"^(?:([+-]?[0-9]+):)?([0-9][0-9A-Za-z.+~:-]*?)(?:-([0-9A-Za-z.+~]+))?\z"


def _deb_part(s: str) -> str:
    """Runs of other characters, "~" below the end, letters above it, the rest above letters; then a number."""
    pairs = f"filter(regexp_extract_all({s}, '[^0-9]*[0-9]*', 0), p -> p <> '')"
    pair = f"concat(translate(regexp_replace(p, '[0-9]+\\\\z', ''), '~+-.:', '!{{|}}~'), '#', {_num(_q_group('p', '([0-9]*)\\\\z'))})"
    return f"concat(case when {s} = '' then '#10' else array_join(transform({pairs}, p -> {pair}), '') end, '#')"


def _q_group(v: str, pattern: str) -> str:
    return f"regexp_extract({v}, '{pattern}', 1)"


def deb_key(v: str) -> str:
    t = f"trim(BOTH ' \\t\\n\\r' FROM {v})"
    epoch = f"try_cast(coalesce(nullif({_group(t, _DEB, 1)}, ''), '0') as bigint)"
    whole = f"(not contains({t}, '-') or {_group(t, _DEB, 3)} <> '') and (not contains({t}, ':') or {_group(t, _DEB, 1)} <> '')"  # a dash parts off a revision, a colon an epoch
    return f"case when {t} rlike {_q(_DEB)} and {whole} and {epoch} >= 0 then concat(lpad(cast({epoch} as string), 19, '0'), {_deb_part(_group(t, _DEB, 2))}, {_deb_part(_group(t, _DEB, 3))}) end"


_RPM = r"^(?:([0-9]*):)?([^ \t\n\r]+?)(?:-([^ \t\n\r-]+))?\z"


def _rpm_part(s: str) -> str:
    token = f"case when t = '~' then '0' when t = '^' then '2' when t < ':' then concat('4', {_num('t')}) else concat('3', t, '!') end"
    return f"concat(array_join(transform(regexp_extract_all({s}, '[0-9]+|[A-Za-z]+|~|\\\\^', 0), t -> {token}), ''), '1')"


def rpm_key(v: str) -> str:
    epoch = f"try_cast(coalesce(nullif({_group(v, _RPM, 1)}, ''), '0') as bigint)"
    return f"case when {v} rlike {_q(_RPM)} and not {v} rlike '-\\\\z' and {epoch} is not null then concat(lpad(cast({epoch} as string), 19, '0'), {_rpm_part(_group(v, _RPM, 2))}, {_rpm_part(_group(v, _RPM, 3))}) end"


_APK = r"^([0-9]+)((?:\.[0-9]+)*+)([a-z]?)([0-9]*)((?:_(?:alpha|beta|pre|rc|cvs|svn|git|hg|p)[0-9]*)*+)(~[0-9a-f]+)?(-r[0-9]+)?\z"
#: Suffixes in ascending order, those below the plain version and those above it.
_APK_BELOW, _APK_ABOVE = ("alpha", "beta", "pre", "rc"), ("cvs", "svn", "git", "hg", "p")


def apk_key(v: str) -> str:
    """Kinds by rank: suffix below 0, end 1, revision 2, hash 3, number of a suffix 4, suffix above 5, letter 6, component 7, first 8."""
    g = lambda n: _group(v, _APK, n)
    dotted = f"array_join(transform(filter(split({g(2)}, '[.]'), c -> c <> ''), c -> case when c like '0%' then concat('70', c, '!') else concat('71', {_num('c')}) end), '')"
    letter = f"case when {g(3)} = '' then '' else concat('6', {g(3)}, case when {g(4)} = '' then '' else concat('71', {_num(g(4))}) end) end"
    names = " ".join([*(f"when '{s}' then '0{i}'" for i, s in enumerate(_APK_BELOW)), *(f"when '{s}' then '5{i}'" for i, s in enumerate(_APK_ABOVE))])
    digits = "regexp_extract(s, '([0-9]*)\\\\z', 1)"
    suffixes = f"array_join(transform(filter(split({g(5)}, '_'), s -> s <> ''), s -> concat(case regexp_extract(s, '^[a-z]+', 0) {names} end, case when {digits} = '' then '' else concat('4', {_num(digits)}) end)), '')"
    ends = f"case when {g(6)} = '' then '' else concat('3', substring({g(6)}, 2), '!') end, case when {g(7)} = '' then '' else concat('2', {_num(f'substring({g(7)}, 3)')}) end, '1'"
    return f"case when {v} rlike {_q(_APK)} and not ({g(3)} = '' and {g(4)} <> '') then concat('8', {_num(g(1))}, {dotted}, {letter}, {suffixes}, {ends}) end"


_LABEL = r"(?:(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(?![0-9A-Za-z-]))"
_NUGET = rf"^([0-9]+(?:\.[0-9]+){{0,3}})(?:-(?:({_LABEL}(?:\.{_LABEL})*+)|(?=\+.)))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*+)?\z"


def nuget_key(v: str) -> str:
    t = f"trim(BOTH ' \\t\\n\\r' FROM {v})"
    parts = f"split({_group(t, _NUGET, 1)}, '[.]')"
    fits = f"forall({parts}, p -> length(regexp_replace(p, '^0+', '')) <= 10 and cast(regexp_replace(p, '^0+(?=.)', '') as decimal(20)) <= 2147483647)"
    numbers = ", ".join(_num(f"coalesce(get({parts}, {i}), '0')") for i in range(4))
    labels = _group(t, _NUGET, 2)
    whole = "case when i rlike '^-?[0-9]+\\\\z' then try_cast(i as int) end"
    ids = f"array_join(transform(split({labels}, '[.]'), i -> case when ({whole}) is not null then concat('1', lpad(cast(cast({whole} as bigint) + 2147483648 as string), 10, '0')) else concat('2', upper(i), '!') end), '')"
    return f"case when {t} rlike {_q(_NUGET)} and {fits} then concat({numbers}, case when {labels} = '' then '~' else concat({ids}, '!') end) end"




def _number(digits: str) -> str:
    d = digits.lstrip("0")
    n = str(len(d))
    return f"{len(n)}{n}{d}"


_GEM = re.compile(r"\s*[0-9]+(\.[0-9a-zA-Z]+)*(-[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?\s*", re.A)
_NINES = str.maketrans("0123456789", "9876543210")


def gem_key(v: str) -> str | None:
    """A shorter version compares as if it went on with zeros, so a run of zeros counts by what ends it: before a word
    it lies below the end, the longer the nearer to it; before a number above the end, likewise."""
    if not _GEM.fullmatch(v):
        return None
    segs = re.findall(r"[0-9]+|[A-Za-z]+", v.strip().replace("-", ".pre."))
    zero = lambda s: not s.strip("0")
    while segs and zero(segs[-1]):
        segs.pop()
    first = next((i for i, s in enumerate(segs) if s[0].isalpha()), None)
    if first is not None:
        cut = first
        while cut and zero(segs[cut - 1]):
            cut -= 1
        segs[cut:first] = []
    out, run = [], 0
    for s in segs:
        if zero(s):
            run += 1
            continue
        length = _number(str(run))
        out.append(f"0{length}{s}!" if s[0].isalpha() else f"2{length.translate(_NINES)}{_number(s)}")
        run = 0
    return "".join(out) + "1"


#: Marks the key of a dev- branch, which equals itself and has no order against anything else.
BRANCH = "dev-"
#: Composer's stability words, how they are written out, and its form of versions that are dates.
_COMPOSER_WORDS = {"stable": "", "dev": "dev", "a": "alpha", "alpha": "alpha", "b": "beta", "beta": "beta", "rc": "RC", "p": "patch", "pl": "patch", "patch": "patch"}
_COMPOSER_DATE = re.compile(r"[0-9]{4}(?:[.:-]?[0-9]{2}){1,6}(?:[.:-]?[0-9]{1,3}){0,2}")
_COMPOSER_RANK = {"stable": "/", "dev": "0", "alpha": "1", "beta": "2", "RC": "3", "patch": "6"}


def _composer_numbers(head: str) -> str | None:
    """The numbers of a version: one to four of them, padded to four, or a date."""
    numbers = head.split(".")
    if len(numbers) <= 4 and all(n.isdigit() for n in numbers) and len(numbers[0]) <= 5:
        return ".".join(numbers + ["0"] * (4 - len(numbers)))
    return re.sub("[^0-9]", ".", head) if _COMPOSER_DATE.fullmatch(head) else None


def _composer_release(s: str) -> str | None:
    """Numbers, then a stability word with its own numbers, then dev; each part may be set off by a separator."""
    body = s[1:] if s[:1] in ("v", "V") else s
    dev = body[-3:].lower() == "dev"
    if dev:
        body = body[:-4] if body[-4:-3] in (".", "-") else body[:-3]
    at = next((i for i, c in enumerate(body) if c.isalpha()), len(body))
    head, tail = body[:at], body[at:]
    split = next((i for i, c in enumerate(tail) if not c.isalpha()), len(tail))
    word, count = tail[:split].lower(), tail[split:]
    if word and (word == "dev" or word not in _COMPOSER_WORDS):
        return None
    if not re.fullmatch(r"(?:[.-]?[0-9]++)*+", count, re.A) or (count and not word):
        return None
    if head[-1:] in (".", "_", "-"):
        head = head[:-1]
    numbers = _composer_numbers(head)
    if numbers is None:
        return None
    # The word is left out as it is written in small letters only; in others it is one that lies below all the rest.
    label = "stable" if word == "stable" and tail[:split] != word else _COMPOSER_WORDS.get(word, "")
    return numbers + (f"-{label}{count.lstrip('.-')}" if label else "") + ("-dev" if dev else "")


def _composer_branch(s: str) -> str | None:
    """A numbered branch: 1.x-dev and the like, with the open places as large numbers."""
    if s[-3:].lower() != "dev":
        return None
    name = s[:-4] if s[-4:-3] in (".", "-") else s[:-3]
    places = (name[1:] if name[:1] in ("v", "V") else name).split(".")
    if len(places) > 4 or not places[0].isdigit() or not all(p.isdigit() or p in ("x", "X", "*") for p in places[1:]):
        return None
    return ".".join(p if p.isdigit() else "9999999" for p in places + ["x"] * (4 - len(places))) + "-dev"


def composer_normal(v: str) -> str | None:
    """A version in Composer's long form, or dev- and a branch's name."""
    s = v.strip()
    if not s.isascii():
        return None if s[:4].lower() != BRANCH else BRANCH + s[4:]
    alias = s.split(" as ")
    if len(alias) == 2 and alias[0].strip(" ") and alias[1].strip(" ") and not re.search(r"[,\s]", alias[0].strip(" ") + alias[1].strip(" ")):
        s = alias[0].strip(" ")
    at = s.rfind("@")
    if at >= 0 and s[at + 1 :].lower() in ("stable", "rc", "beta", "alpha", "dev"):
        s = s[:at]
    if s.lower() in ("master", "trunk", "default"):
        return BRANCH + s
    if s[:4].lower() == BRANCH:
        return BRANCH + s[4:]
    version, plus, build = s.partition("+")
    if plus and version and build and not re.search(r"[,\s]", version) and not re.search(r"\s", build):
        s = version
    return _composer_release(s) or _composer_branch(s)


def composer_key(v: str) -> str | None:
    n = composer_normal(v)
    if n is None or n.startswith(BRANCH):
        return n
    return "".join(f"5{_number(s)}" if s[0].isdigit() else _COMPOSER_RANK[s] for s in re.findall(r"[0-9]+|[A-Za-z]+", n)) + "4"


PYTHON: dict[str, Callable[[str], str | None]] = {"gem": gem_key, "composer": composer_key}


# ---- Maven: tokens are read into a tree, and two trees are compared ----

_MAVEN_ALIAS = {"ga": "", "final": "", "release": "", "cr": "rc"}
_MAVEN_SHORT = {"a": "alpha", "b": "beta", "m": "milestone"}
_MAVEN_ORDER = {q: i for i, q in enumerate(["alpha", "beta", "milestone", "rc", "snapshot", "", "sp"])}


_MAVEN_PLAIN = r"^([0-9]{1,9}(?:[.][0-9]{1,9})*+)(?:[.-]?([a-z]+)([0-9]{0,9}))?\z"


def maven_key(v: str) -> str:
    """For versions of numbers and at most one qualifier with a number, among which the order is one of keys: numbers
    above qualifiers that follow a release, then the end, then qualifiers that precede one. Null for all others."""
    short = " ".join(f"when '{a}' then '{b}'" for a, b in _MAVEN_SHORT.items())
    alias = " ".join(f"when '{a}' then '{b}'" for a, b in _MAVEN_ALIAS.items())
    rank = " ".join(f"when '{q}' then '{i}'" for q, i in _MAVEN_ORDER.items())
    # Numbers at the end that are 0 go: all zeros and points at the end, but for zeros that belong to the number before.
    cut = _let("trim(TRAILING '.0' FROM g[1])", "t", "case when t = '' then '' else concat(t, regexp_extract(substring(g[1], length(t) + 1), '^0*', 0)) end")
    numbers = _let(cut, "r", f"case when r = '' then '' else array_join(transform(split(r, '[.]'), i -> concat('9', {_num('i')})), '') end")
    named = _let(f"case when g[3] <> '' then case g[2] {short} else g[2] end else g[2] end", "w", f"case w {alias} else w end")
    number = _let("regexp_replace(g[3], '^0+', '')", "n", f"case when n = '' then '0' else concat('1', {_num('n')}) end")
    order = f"case q {rank} else concat('7', q, '!') end"
    tail = f"case when q = '' then case when m = '0' then '5' end else concat(case when {order} < '5' then '1' else '7' end, {order}, m) end"
    end = f"case when g[2] = '' then '5' else {_let(named, 'q', _let(number, 'm', tail))} end"
    return _let(_groups(f"lower({v})", _MAVEN_PLAIN, 3), "g", f"case when g is not null then concat({numbers}, {end}) end")


NATIVE: dict[str, Callable[[str], str]] = {"semver": semver_key, "pep440": pep440_key, "deb": deb_key, "rpm": rpm_key, "apk": apk_key, "nuget": nuget_key, "maven": maven_key}


def maven_tree(v: str) -> tuple | None:
    """The tree of a version, kept for short ones only."""
    return _kept_tree(v) if len(v) <= MAX_LENGTH else _maven_tree(v)


def _maven_tree(v: str) -> tuple | None:
    """Nested tuples of numbers (digit strings), qualifiers ("q", name) and lists; None if blank."""
    if not v.strip():
        return None
    root: list = []
    chain = [root]

    def deeper() -> None:
        chain[-1].append([])
        chain.append(chain[-1][-1])

    def add(token: str, before_digit: bool = False) -> None:
        if token[0].isdigit():
            chain[-1].append(token.lstrip("0") or token)
        else:
            name = _MAVEN_SHORT.get(token, token) if before_digit else token
            chain[-1].append(("q", _MAVEN_ALIAS.get(name, name)))

    tokens = re.findall(r"[0-9]+|[^0-9.\-]+|[.\-]", v.lower())
    after = "."  # the last separator, or the kind of the token before
    for i, t in enumerate(tokens):
        following = tokens[i + 1] if i + 1 < len(tokens) else ""
        if t in ".-":
            if after in ".-":
                chain[-1].append("0")
            if t == "-":
                deeper()
            after = t
        elif t[0].isdigit():
            add(t)
            if following and following not in ".-":
                deeper()
            after = "n"
        else:
            digit_next = following[:1].isdigit()
            if (digit_next or not following) and chain[-1]:
                deeper()
            add(t, digit_next)
            if digit_next:
                deeper()
            after = "q"

    # A list has at most one list in it, its last item: chain holds them all, and they close from within.
    inner: tuple = ()
    for level in reversed(chain):
        items = [x for x in level if not isinstance(x, list)]
        while items and _maven_null(items[-1]):  # trailing nulls go, also before a list
            items.pop()
        inner = (*items, inner) if inner else tuple(items)
    return inner


_kept_tree = functools.lru_cache(maxsize=50_000)(_maven_tree)


def _maven_list(x) -> bool:
    return isinstance(x, tuple) and x[:1] != ("q",)


def _maven_null(x) -> bool:
    return not x.strip("0") if isinstance(x, str) else x == ("q", "") or x == ()


def _maven_qualifier(name: str) -> tuple:
    return (_MAVEN_ORDER.get(name, 7), name if name not in _MAVEN_ORDER else "")


def _sign(a, b) -> int:
    return (a > b) - (a < b)


def _maven_alone(a: tuple) -> int:
    """A list against nothing: the first item that isn't neutral decides, however deep it lies."""
    while a:
        inner: tuple = ()
        for x in a:
            if _maven_list(x):
                inner = x
            elif c := _maven_items(x, None):
                return c
        a = inner
    return 0


def _maven_items(a, b) -> int:
    """Numbers above lists above qualifiers; an absent item stands for the neutral one of the other's kind. Not for two
    lists."""
    if a is None:
        return 0 if b is None else -_maven_items(b, None)
    if isinstance(a, str):
        if b is None:
            return int(not _maven_null(a))
        if isinstance(b, str):
            rank = lambda s: (0 if len(s) <= 9 else 1 if len(s) <= 18 else 2, len(s.lstrip("0")), s.lstrip("0"))
            return _sign(rank(a), rank(b))
        return 1
    if _maven_list(a):
        return _maven_alone(a) if b is None else -1 if isinstance(b, str) else 1
    if b is None:
        return _sign(_maven_qualifier(a[1]), _maven_qualifier(""))
    return _sign(_maven_qualifier(a[1]), _maven_qualifier(b[1])) if isinstance(b, tuple) and not _maven_list(b) else -1


def _maven_lists(a: tuple, b: tuple) -> int:
    """Item by item; lists stand last, so two of them at one place are what is left to compare."""
    while True:
        deeper = None
        for i in range(max(len(a), len(b))):
            x, y = a[i] if i < len(a) else None, b[i] if i < len(b) else None
            if x is not None and y is not None and _maven_list(x) and _maven_list(y):
                deeper = x, y
            elif c := _maven_items(x, y):
                return c
        if deeper is None:
            return 0
        a, b = deeper


def maven_compare(a: str, b: str) -> int | None:
    x, y = maven_tree(a), maven_tree(b)
    return None if x is None or y is None else _maven_lists(x, y)


@F.pandas_udf(IntegerType())
def maven_compare_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else maven_compare(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(ArrayType(StringType()))
def python_keys(comparer: pd.Series, versions: pd.Series) -> pd.Series:
    return pd.Series([None if vs is None else [None if v is None or c not in PYTHON else PYTHON[c](v) for v in vs] for c, vs in zip(comparer, versions, strict=True)])


def comparer_of(ecosystem: str | Column) -> Column:
    """The comparer's name for an ecosystem key, null if there is none."""
    e = F.col(ecosystem) if isinstance(ecosystem, str) else ecosystem
    family = F.split_part(e, F.lit(":"), F.lit(1))
    out = None
    for name, families in FAMILIES.items():
        with_release = [f for f in families if f in NEEDS_RELEASE]
        bare = [f for f in families if f not in NEEDS_RELEASE]
        condition = F.lit(False)
        if bare:
            condition = condition | e.isin(bare)
        if with_release:
            condition = condition | (family.isin(with_release) & e.contains(":") & ((family != "Ubuntu") | e.rlike(MAINLINE_UBUNTU)))
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out


def native_key(comparer: str, version: str) -> str:
    """SQL for the key of a version by one of the native comparers; comparer and version are SQL."""
    return "case " + comparer + " " + " ".join(f"when '{n}' then {k(version)}" for n, k in NATIVE.items()) + " end"


def key(comparer: str, version: str) -> Column:
    """The key of a column by a fixed native comparer."""
    return F.expr(NATIVE[comparer](version))
