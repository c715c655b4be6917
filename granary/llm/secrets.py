"""p2 - credentials in code, settings and notes, found line by line and blanked.

A keyword automaton (credential words and issuers' prefixes) picks the lines worth a
look; issuer formats, assignments to credential names, URLs, headers, key blocks and
encoded values are matched there; the structure of each value is validated, and what
stands is replaced by a placeholder of the same length and alphabet.

Texts are scanned where they lie. Only what depends on the kind of file (unquoted values of
settings, lines of a password file) waits for its path, and only those few rows are joined.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words by which a line may hold a credential, and prefixes issuers use.
KEYWORDS = (
    "passw", "passphrase", "passcode", "_pass", "-pass", ".pass", "pass=", "pass =", "pass:", "pass|", "pass\"", "pass'", "pwd", "secret",
    "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "access-key", "auth_key", "authkey", "private_key",
    "privatekey", "private-key", "signing", "signature", "sig=", "encryption", "masterkey", "master_key", "master-key",
    "session_key", "sessionkey", "client_key", "clientkey", "service_key", "deploy_key", "storage_key", "credential",
    "bearer ", "basic ", "_auth", "key=", "accountkey", "account_key", "sharedaccess", "://", "private key", "akia", "asia",
    "aiza", "xoxa-", "xoxb-", "xoxp-", "xoxo-", "xoxe-", "xoxr-", "xoxs-", "sg.", "eyj", "glpat-", "npm_", "sk_live_",
    "rk_live_", "pk_live_", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "pypi-", "hf_", "sk-", "client(",
)

# Formats in which issuers hand out keys and tokens.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"
    r"|AIza[\w-]{30,45}(?![\w-])"
    r"|xox[abeoprs]-[\w-]{20,}"
    r"|SG\.[\w-]{16,32}\.[\w-]{30,64}(?![\w-])"
    r"|glpat-[\w-]{20,}"
    r"|npm_[A-Za-z0-9]{30,}"
    r"|[srp]k_live_[A-Za-z0-9]{16,}"
    r"|gh[pousr]_[A-Za-z0-9]{30,}"
    r"|github_pat_\w{22,}"
    r"|pypi-[\w-]{30,}|hf_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{32,}"
    r"|eyJ[\w-]{10,}\.eyJ[\w-]{4,}\.[\w-]{10,}"
    r")"
)
_NAME = (
    r"(?:pass(?:word|wd|phrase|code)s?|passwd|pwd|(?<![a-z])pass|secret(?:s|[_-]?(?:key|token|access[_-]?key))?|token"
    r"|(?:api|access|master|signing|signature|encryption|private|auth|session|shared[_-]?access|account|client|service|deploy|storage)[_-]?key"
    r"|credentials?|_auth|_?authtoken)"
)
# A credential's name as the last part of a key, whatever the case style.
NAME = re.compile(r"(?:^|.*?)(?:" + _NAME + r"|(?:_|-|\.|user|smtp|mail|db|pg|ftp|root|admin|login|proxy|http|my)pass)\d*$", re.I)
_VALUE_Q = r"(?P<q>['\"`])(?P<v>(?:\\.|(?!(?P=q)).)*)(?P=q)"
_ASSIGN = re.compile(
    r"(?P<n>[A-Za-z_][\w.\-]*|(?<=:)_[A-Za-z]+)['\"]?\]?[ \t]*(?::=|=>|=|:)[ \t]*(?P<rest>\S.*)$", re.I
)
_ASSIGN_ANY = re.compile(r"([A-Za-z_][\w.\-]*)['\"]?\]?\s*(?:::?=|=>|[=:,]|\|\||\?\?)\s*(['\"`])((?:\\.|(?!\2).)*)\2")
_CLI_LIST = re.compile(r"['\"]--?([A-Za-z][\w-]*)['\"]\s*,\s*(['\"])((?:\\.|(?!\2).)*)\2")
_CLI = re.compile(r"--?([A-Za-z][\w-]*)[= ](['\"]?)([^\s'\"]+)\2")
_OR = re.compile(r"([A-Za-z_][\w.\-]*)['\"\])]*\s*(?:\|\||\?\?|\bor\b|:-)\s*(['\"])((?:\\.|(?!\2).)*)\2")
_JOINED = re.compile(r"^(['\"])((?:\\.|(?!\1).)*)\1(?:\s*(?:\+|\.\.?|\\|&|\|\|)?\s*(['\"])((?:\\.|(?!\3).)*)\3)+")
_URL = re.compile(r"[a-z][a-z0-9+.\-]*://(?P<u>[^\s/:@'\"]*):(?P<p>[^\s@'\"/]+|[^\s'\"@]+)@", re.I)
_QUERY = re.compile(r"[?&;](?P<n>[A-Za-z_\-]*(?:token|key|sig|signature|secret|password|pwd|auth)[A-Za-z_\-]*)=(?P<v>[^\s&'\"#<>]+)", re.I)
_CONN = re.compile(r"\b(?:pwd|password|accountkey|sharedaccesskey|secret)\s*=\s*(?P<v>[^;'\"\s]+)", re.I)
_BEARER = re.compile(r"\b(?:Bearer|token)\s+(?P<v>[A-Za-z0-9_\-.~+/]{12,}=*)", re.I)
_BASIC = re.compile(r"\bBasic\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})")
_SAID = re.compile(r"\b(?:password|passphrase|identified by)\s+(?:is\s+)?(['\"`])(?P<v>[^'\"`]+)\1", re.I)
_REMARK = re.compile(r"\s*(?:#|//|--|/?\*|;|<!--)")
_REMARKED = re.compile(r"(?P<n>[A-Za-z_][\w.\-]*)\s*[:=]\s*['\"]?(?P<v>[^\s'\",;]{8,})")
_USER = re.compile(r"(?:^|\s)(?:-u|--user)[ =]['\"]?[^\s:'\"]+:(?P<v>[^\s'\"]+)")
_NETRC = re.compile(r"(?:^|\s)password\s+(?P<v>\S+)")
_PGPASS = re.compile(r"^[^\s:#]+:(?:\d+|\*):[^\s:]+:[^\s:]+:(?P<v>\S+?)\r?$", re.M)
_HELD_OPEN = re.compile(r"([A-Za-z_][\w.\-]*)['\"]?\]?\s*(?:=>|:?=|:)\s*(?:\(|\\|[|>][-+]?|\[|\"\"\"|''')?\s*\\?$")
_SAID_NAME = re.compile(r"\bname['\"]?\s*:\s*['\"]?([A-Za-z_][\w.\-]*)")
_SAID_VALUE = re.compile(r"^\s*['\"]?value['\"]?\s*:\s*(?P<rest>\S.*)$")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINE = re.compile(r"^\W*[A-Za-z0-9+/]{16,}={0,2}(?:\\[nr])*\W*$|^\W*[A-Za-z0-9+/]{1,76}={0,2}(?:\\[nr])*\W*$|^[\s#/*'\"+]*(?:Proc-Type|DEK-Info|Comment).*$")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_KEY_REST = re.compile(r"(?:\\[nr]|[A-Za-z0-9+/= ])*")
_KEY_HEADER = re.compile(r"[\s#/*'\"+]*(?:Proc-Type|DEK-Info|Comment)")
_CLIENT = re.compile(r"\bClient\(\s*(['\"])[^'\"]*\1\s*,\s*(['\"])(?P<v>[^'\"]+)\2")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_=.\-])[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/_=\-])")
_DUMMY = re.compile(
    r"(?:^$|change[\s_-]?(?:me|it|this)|your[\s_-]|not[\s_-]?a[\s_-]?real|redacted|secret[\s_-]?here|goes[\s_-]?here"
    r"|^[a-z\s_-]*\b_?(?:example|placeholder|insert|dummy|fake|sample|replace|todo|fixme|tbd|to[\s_-]be)(?![a-z])[a-z\s_-]*$|<[^>]*>|%[A-Z_]+%|\{\{.*\}\}|\$\{|\$\(|^\$[A-Za-z_]|^%\w|^@\w+@$|\{[A-Za-z_][\w.]*\}"
    r"|^(?:null|none|nil|true|false|undefined|required|optional|n/?a|empty|unset|string|changed|password|secret|token|hidden|masked|value|xxx+|env)$"
    r"|^(.)\1+$|^[x*.\-_•#]+$|ENC\[|^enc:|^AQICAH|^vault:|^\{cipher\}|^\$(?:2[abxy]?|5|6|argon2\w*|pbkdf2[\w-]*|scrypt)\$|^(?:sha\d+|md5|pbkdf2|bcrypt|argon2)[-:$]"
    r"|^(?:op|ref|ssm|secretsmanager|file|env|arn|projects)[:/]|^/(?:run|etc|var|secrets|mnt|home|opt)/|^\.{0,2}/(?-i:[a-z][a-z_.\-]*)/)",
    re.I,
)
_REFERENCE = re.compile(
    r"^(?:process\.|os\.|env[.\[(]|config[.\[(]|settings[.\[(]|self\.|this\.|await\b|new\b|get\w*\(|ask\w*\(|[A-Za-z_][\w.]*\(|[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*|\[)+)"
)
_TALK = re.compile(r"^(?:required|invalid|must|should|missing|expired|wrong|at-least)", re.I)
_SETTINGS = re.compile(r"(?:^|[/\\])(?:\.env[\w.\-]*|\.npmrc|\.netrc|_netrc|\.pgpass|\.pypirc|credentials|[\w.\-]+\.(?:env|properties|ini|cfg|conf|toml|ya?ml|tfvars|env\w*))$", re.I)
_PLAIN = re.compile(r"^[A-Za-z_]+$|^[a-z]+(?:[-_ ][a-z]+)*$|^\d{1,5}$")


_LAYOUT = str.maketrans("", "", "\r\n\t")  # characters of a text in several lines; as printable as others
# What a placeholder leaves as it is: escape sequences, percent codes and character references.
_CODES = re.compile(r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[0-7]{1,3}|.)|%[0-9A-Fa-f]{2}|&(?:#\d+|#x[0-9A-Fa-f]+|amp|lt|gt|quot|apos|nbsp);")
_MASK = re.compile(r"[^A-Za-z1-9]*[xX0](?:[xX0]|[^A-Za-z1-9])*")
_HEX = re.compile(r"(?=[^a-fA-F]*[a-fA-F])(?=[^0-9]*[0-9])(?:0[xX])?(?:[0-9a-f][\-:]?){16,}|(?:0[xX])?(?:[0-9A-F][\-:]?){16,}")
ALWAYS, IN_SETTINGS, IN_PASSWORD_FILE = 0, 1, 2  # what a span needs to know of its file


def is_masked(value: str) -> bool:
    """Of all letters and digits only x, X and 0 are left: what ``blank`` puts in place of a credential."""
    return _MASK.fullmatch(_CODES.sub("", value)) is not None


def is_dummy(value: str) -> bool:
    """Empty, masked, to be filled in, a reference, encrypted, or hashed."""
    v = value.strip()
    return not v or bool(_DUMMY.search(v)) or is_masked(v)


def _decoded(value: str) -> str | None:
    """The printable text that base64 hides, if it hides any."""
    raw = value.strip()
    if len(raw) < 8 or len(raw) % 4 == 1:
        return None
    try:
        text = base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    text = text.rstrip("\r\n")
    return text if text and text.translate(_LAYOUT).isprintable() else None


# Tokens of a prefix and 36 characters, of which the last six are a checksum of the others; its digits.
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(token: str) -> bool:
    """Whether the CRC32 that some issuers put at a token's end is right; true for tokens that carry none."""
    m = _CHECKED.fullmatch(token)
    if not m:
        return True
    rest, digits = zlib.crc32(m[1].encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = _DIGITS[digit] + digits
    return digits == m[2]


def _structured(token: str, checksums: bool = False) -> bool:
    """Whether an issued-looking token holds together: a JWT's header must be JSON; no EXAMPLE keys, no masks."""
    if re.search(r"EXAMPLE|(.)\1{7}", token) or is_masked(token):
        return False
    if checksums and not checksum_holds(token):
        return False
    if token.startswith("eyJ"):
        head = token.split(".")[0]
        try:
            return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
        except (ValueError, binascii.Error):
            return False
    return True


def _named(name: str) -> bool:
    """Whether a key's name is that of a credential itself, not of something about it."""
    return bool(NAME.match(name))


def _valid(value: str, loose: bool) -> bool:
    """A literal that may be a credential. ``loose``: its name already says so."""
    v = value.strip()
    if is_dummy(v) or _TALK.match(v):
        return False
    if loose:
        return not re.fullmatch(r"[a-z]+(?:[ ,.][a-z]+)+[.!?]?", v)
    return bool(re.search(r"\d", v) and re.search(r"[A-Za-z]", v)) and " " not in v


def _bare(rest: str) -> str:
    """An unquoted value: up to white space, a comment or a closing mark."""
    rest = rest.strip()
    return re.split(r"\s+(?:#|//|--)|\s+$", rest)[0].rstrip(",")


class Scanner:
    """Finds the credential spans of one text; compiled once by a worker.

    With ``checksums`` issued tokens whose own checksum fails are no credentials by their
    format alone; a credential's name before them still makes them one.
    """

    def __init__(self, checksums: bool = False):
        import ahocorasick

        self.checksums = checksums
        self.automaton = ahocorasick.Automaton()
        for word in KEYWORDS:
            self.automaton.add_word(word, len(word))
        self.automaton.make_automaton()

    def _candidates(self, low: str) -> list[int]:
        """Indexes of the lines that hold a keyword, from one pass over the lower-case text."""
        places = [at for at, _ in self.automaton.iter(low)]
        if not places:
            return []
        out, line, start = [], 0, 0
        for at in places:
            if at < start:
                continue
            line += low.count("\n", start, at)
            out.append(line)
            start = low.find("\n", at)
            if start < 0:
                break
            start, line = start + 1, line + 1
        return out

    def spans(self, text: str | None, path: str | None = None) -> list[tuple[int, int, int]]:
        """(line, start, end) of every credential part, columns within the line, lines from 1."""
        fits = {ALWAYS}
        if path and _SETTINGS.search(path):
            fits.add(IN_SETTINGS)
        if "pgpass" in (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower():
            fits.add(IN_PASSWORD_FILE)
        return [span[:3] for span in self.conditional_spans(text) if span[3] in fits]

    def conditional_spans(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(line, start, end, need) of every span that is a credential part in some kind of file."""
        if not text:
            return []
        low = text.lower()
        candidates = self._candidates(low)
        encoded = _B64.search(text) is not None
        passwords = _PGPASS.search(text) is not None
        if not passwords and not candidates and not encoded:
            return []
        lines = text.split("\n")
        found: dict[tuple[int, int, int], int] = {}

        def hit(i: int, start: int, end: int, need: int = ALWAYS) -> None:
            span = (i + 1, start, end)
            found[span] = min(need, found.get(span, need))

        in_key = self._key_lines(lines, hit) if "private key" in low else set()
        manifest = "kind: secret" in low
        if passwords:
            for i, line in enumerate(lines):
                m = _PGPASS.match(line.rstrip("\r"))
                if m and not is_dummy(m["v"]):
                    hit(i, *m.span("v"), IN_PASSWORD_FILE)
        for i in candidates:
            if i not in in_key:
                self._line(i, lines[i], manifest, hit)
                self._next_lines(i, lines, hit)
        if encoded:
            self._encoded(text, in_key, hit)
        return sorted((*span, need) for span, need in found.items())

    def _key_lines(self, lines: list[str], hit) -> set[int]:
        """Private keys in several lines, also where a text starts or ends inside one; the code around them is no part."""
        taken: set[int] = set()

        def take(i: int) -> None:
            taken.add(i)
            begin, end = _BEGIN.search(lines[i]), _END.search(lines[i])
            body = max(_KEY_BODY.finditer(lines[i]), key=lambda m: m.end() - m.start(), default=None)
            if begin and end:
                hit(i, begin.start(), end.end())
            elif begin:
                hit(i, begin.start(), max(begin.end(), _KEY_REST.match(lines[i], begin.end()).end()))
            elif end:
                hit(i, min(end.start(), body.start() if body else end.start()), end.end())
            elif body and not _KEY_HEADER.match(lines[i]):
                hit(i, *body.span())
            else:
                stripped = lines[i].strip()
                at = lines[i].find(stripped)
                hit(i, at, at + len(stripped))

        for i, line in enumerate(lines):
            if i in taken:
                continue
            if _BEGIN.search(line):
                body = line[_BEGIN.search(line).end() :]
                if len(re.findall(r"[A-Za-z0-9+/]", body.split("-----")[0])) >= 24:
                    take(i)  # the whole key on one line
                    continue
                j = i + 1
                while j < len(lines) and not _END.search(lines[j]) and _KEY_LINE.match(lines[j].rstrip("\r") or " "):
                    j += 1
                ended = j < len(lines) and bool(_END.search(lines[j]))
                if not ended:  # cut off, or no key at all: only lines as long as a key's count
                    j = i + 1
                    while j < len(lines) and re.search(r"[A-Za-z0-9+/]{40,}", lines[j]) and _KEY_LINE.match(lines[j].rstrip("\r")):
                        j += 1
                if j > i + 1 or (i + 1 == len(lines) and line.strip().startswith("-----BEGIN")):
                    for k in range(i, j + ended):
                        take(k)
            elif _END.search(line):
                j = i - 1
                while j >= 0 and j not in taken and _KEY_LINE.match(lines[j].rstrip("\r") or " "):
                    j -= 1
                if j < i - 1 or (i == 0 and line.strip().startswith("-----END")):
                    for k in range(j + 1, i + 1):
                        take(k)
        return taken

    def _line(self, i: int, line: str, manifest: bool, hit) -> None:
        for m in ISSUED.finditer(line):
            if _structured(m[0], self.checksums):
                hit(i, *m.span())
        for m in _URL.finditer(line):
            if not is_dummy(m["p"]) and not _REFERENCE.match(m["p"]):
                hit(i, *m.span("p"))
        for m in _QUERY.finditer(line):
            if _valid(m["v"], False) and len(m["v"]) >= 12:
                hit(i, *m.span("v"))
        for m in _BEARER.finditer(line):
            if _valid(m["v"], False):
                hit(i, *m.span("v"))
        for m in _BASIC.finditer(line):
            inner = _decoded(m["v"])
            if inner and ":" in inner and not is_dummy(inner.split(":", 1)[1]):
                hit(i, *m.span("v"))
        for m in _CONN.finditer(line):
            if ";" in line and _valid(m["v"], True) and not _REFERENCE.match(m["v"]):
                hit(i, *m.span("v"))
        for m in _CLIENT.finditer(line):
            if _valid(m["v"], False) and len(m["v"]) >= 16:
                hit(i, *m.span("v"))
        for pattern in (_CLI_LIST, _ASSIGN_ANY, _OR):
            for m in pattern.finditer(line):
                if _named(m[1]) and _valid(m[3], True) and not self._just_words(m[3]):
                    hit(i, *m.span(3))
        for m in _CLI.finditer(line):
            if _named(m[1]) and _valid(m[3], False):
                hit(i, *m.span(3))
        m = _NETRC.search(line)
        if m and _valid(m["v"], True) and (re.search(r"\blogin\s|^\s*password\s+\S+\s*$", line)):
            if not self._just_words(m["v"]):
                hit(i, *m.span("v"))
        for m in _USER.finditer(line):
            if _valid(m["v"], True) and not self._just_words(m["v"]):
                hit(i, *m.span("v"))
        for m in _SAID.finditer(line):
            if _valid(m["v"], True) and not self._just_words(m["v"]):
                hit(i, *m.span("v"))
        if _REMARK.match(line):
            for m in _REMARKED.finditer(line):
                if _named(m["n"]) and _valid(m["v"], False) and not _REFERENCE.match(m["v"]):
                    hit(i, *m.span("v"))
        self._assignments(i, line, manifest, hit)

    def _encoded(self, text: str, in_key: set[int], hit) -> None:
        """Encoded values anywhere in a text, whatever stands around them."""
        line = start = 0
        for m in _B64.finditer(text):
            inner = _decoded(m[0])
            if not inner:
                continue
            line += text.count("\n", start, m.start())
            start = m.start()
            if line not in in_key and self._holds_secret(inner):
                before = text.rfind("\n", 0, start) + 1
                hit(line, start - before, m.end() - before)

    def _holds_secret(self, inner: str) -> bool:
        if any(_structured(x, self.checksums) for x in ISSUED.findall(inner)) or _BEGIN.search(inner) or self._inner_secret(inner):
            return True
        return bool(self.spans(inner, ".env"))  # settings in several lines, JSON, URLs, headers, encoded once more

    @staticmethod
    def _just_words(value: str) -> bool:
        return bool(_PLAIN.match(value)) and not re.search(r"[a-z][A-Z].*\d|\d", value) and "-" not in value

    @staticmethod
    def _inner_secret(inner: str) -> bool:
        m = re.match(r"\s*[\"']?([A-Za-z_][\w.\-]*)[\"']?\s*[:=]\s*(\S.*)$", inner)
        return bool(m) and _named(m[1]) and _valid(m[2], True)

    def _assignments(self, i: int, line: str, manifest: bool, hit) -> None:
        """name = value without quotes, in settings files, comments and manifests; joined literals."""
        body = re.sub(r"^\s*(?:export\s+|set\s+|[#;]+\s*|//+\s*|--\s+|\*\s*|-\s+)*(?:TODO\b[^:]*:\s*)?", "", line)
        at = len(line) - len(body)
        m = re.match(r"(?://\S+?:)?([A-Za-z_][\w.\-]*)\s*(?::=|=|:)\s*(\S.*)$", body)
        if not m or not _named(m[1].rsplit(".", 1)[-1] if "." in m[1] else m[1]):
            return
        rest = m[2].rstrip("\r")
        joined = _JOINED.match(rest)
        if joined:
            whole = "".join(x[1] for x in re.findall(r"(['\"])((?:\\.|(?!\1).)*)\1", joined[0]))
            if _valid(whole, True):
                hit(i, at + m.start(2), at + m.start(2) + len(joined[0]))
            return
        if rest[:1] in "'\"`":
            return
        value = _bare(rest)
        remark = bool(_REMARK.match(line))
        if not _valid(value, True) or " " in value or value[:1] in "([{<|>&*!":
            return
        if _REFERENCE.match(value) or value.endswith((";", ")")):
            return
        if manifest and ":" in line:
            inner = _decoded(value)
            if inner is not None and not is_dummy(inner):
                hit(i, at + m.start(2), at + m.start(2) + len(value))
            return
        tight = "=" in body[: m.start(2)] and not body[: m.start(2)].rstrip("= ").endswith(" ")
        anywhere = (remark and tight) or (tight and re.search(r"\d", value) and len(value) >= 8)
        if not _PLAIN.match(value):
            hit(i, at + m.start(2), at + m.start(2) + len(value), ALWAYS if anywhere else IN_SETTINGS)

    def _next_lines(self, i: int, lines: list[str], hit) -> None:
        """A value on a line after its name: brackets, folded scalars, name and value pairs."""
        indent = lambda line: len(line) - len(line.lstrip())
        said = _SAID_NAME.search(lines[i])
        if said and _named(said[1]):
            item = re.match(r"\s*(?:-\s+)*", lines[i]).end()  # where the keys of the name's item stand
            for j in range(i + 1, len(lines)):
                bare = lines[j].strip()
                if bare and (indent(lines[j]) < item or bare[0] in "}]" or (indent(lines[j]) == item and (bare[0] == "-" or _SAID_NAME.match(bare.lstrip("'\""))))):
                    break
                m = _SAID_VALUE.match(lines[j].rstrip("\r"))
                if m:
                    value = _bare(m["rest"]).strip("'\"")
                    if re.fullmatch(r"[|>]\d?[-+]?\d?", value):
                        self._folded(j, lines, hit)
                    elif _valid(value, True) and not _PLAIN.match(value):
                        at = lines[j].find(value)
                        hit(j, at, at + len(value))
                    return
        opened = _HELD_OPEN.search(re.sub(r"\s+(?:#|//).*$", "", lines[i].rstrip("\r")))
        if not opened or not _named(opened[1].rsplit(".", 1)[-1]) or not re.search(r"[(\\|>\[]\s*[-+]?\s*\\?$|\"\"\"$|'''$", lines[i].rstrip("\r ")):
            return
        self._folded(i, lines, hit)

    def _folded(self, i: int, lines: list[str], hit) -> None:
        """The lines of a value opened at the end of line ``i``, up to the first that is no part of it."""
        head = lines[i].rstrip("\r ")
        scalar = re.search(r":\s*[|>]\d?[-+]?\d?$", head) is not None
        mark = head[-3:] if head.endswith(('"""', "'''")) else None
        key = re.match(r"\s*(?:-\s+)*", head).end()
        for j in range(i + 1, len(lines)):
            line = lines[j].strip()
            if not line or line[0] in ")]}" or re.match(r"[A-Za-z_][\w.\-]*\s*[:=](?!=*$)", line):
                return
            if scalar and len(lines[j]) - len(lines[j].lstrip()) <= key - (key > 0 and head.lstrip()[0] == "-"):
                return
            last = mark is not None and mark in line
            if last:
                line = line[: line.index(mark)].strip()
                if not line:
                    return
            value = line.rstrip(",;\\").strip().strip("+.&").strip()
            quoted = re.fullmatch(r"\(?(['\"])((?:\\.|(?!\1).)*)\1[)\]]?", value)
            value = quoted[2] if quoted else value
            if " " in value or is_dummy(value) or (not quoted and (_PLAIN.match(value) or _REFERENCE.match(value))):
                return
            at = lines[j].find(value)
            hit(j, at, at + len(value))
            if last or (not scalar and line.rstrip(",;")[-1:] in ")]") or (head.endswith("\\") and not re.search(r"[\\+.&(,]$", line)):
                return


def _filled(part: str) -> str:
    fill = lambda c: "x" if c.islower() else "X" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
    return "".join(map(fill, part))


def placeholder(value: str, quoted: bool = True) -> str:
    """As long as the value and of its alphabet: x, X and 0 for letters and digits, 0 alone for hexadecimal values.

    Escape sequences, percent codes and character references stay whole, so that strings and
    URLs stay valid; a bare number stays a number. A value of signs alone becomes x.
    """
    if value.isdigit() and value.isascii() and not quoted:
        return "1" * len(value)
    if _HEX.fullmatch(value):
        return value[:2].replace("X", "x") * value[:2].lower().startswith("0x") + re.sub("[0-9A-Fa-f]", "0", value[2 * value[:2].lower().startswith("0x") :])
    out, at = [], 0
    for m in _CODES.finditer(value):
        out += [_filled(value[at : m.start()]), m[0]]
        at = m.end()
    new = "".join([*out, _filled(value[at:])])
    return new if new != value or is_masked(value) else re.sub(r"[^\s\\'\"`]", "x", value)


def blank(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a placeholder for every span; spans that overlap are filled as one."""
    lines = text.split("\n")
    merged: list[list[int]] = []
    for line, start, end in sorted(spans):
        if merged and merged[-1][0] == line and start < merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
        else:
            merged.append([line, start, end])
    for line, start, end in merged:
        old = lines[line - 1]
        lines[line - 1] = old[:start] + placeholder(old[start:end], old[start - 1 : start] in ("'", '"', "`")) + old[end:]
    return "\n".join(lines)


def _with_paths(found: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``path``, null where a file is not known; ``found`` (id, f, ...) holds what was found, few and narrow rows."""
    paths = files.select(F.col("file_id").cast("bigint").alias("f"), F.col("path").cast("string").alias("path"))
    paths = paths.where("f is not null").groupBy("f").agg(F.min("path").alias("path"))
    paths = paths.select(F.col("f").cast("string").alias("key"), "path")
    # rows without a file have keys of their own, so that they do not meet in one task
    key = F.coalesce(F.col("f").cast("string"), F.concat(F.lit("without "), F.coalesce(F.col("id"), F.lit(0)).cast("string")))
    return found.withColumn("key", key).join(paths, "key", "left").drop("key")


def _fits(need, path):
    """Column: whether a span that needs to know its file counts in the file of this path."""
    base = F.lower(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)$", 1))
    held = (
        F.when(need == ALWAYS, True)
        .when(need == IN_SETTINGS, path.rlike("(?iU)" + _SETTINGS.pattern))
        .otherwise(base.contains("pgpass"))
    )
    return F.coalesce(held, F.lit(False))


def _rows(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return chunks.select(
        F.col(id_col).cast("bigint").alias("id"), F.col("file_id").cast("bigint").alias("f"), F.col(text_col).cast("string").alias("text")
    ).where("text is not null")


def secret_lines(chunks: DataFrame, files: DataFrame, id_col: str = "chunk_id", text_col: str = "text", checksums: bool = False) -> DataFrame:
    """(id, line_no): every line of every chunk on which a credential or a part of one stands.

    ``files`` gives the paths; a chunk without a file is read without one. Null and
    empty texts give no row, repeated rows give one row, a null id is kept, whole texts
    are read, other columns are ignored. With ``checksums`` tokens whose checksum fails
    do not count by their format alone.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(checksums)
        for batch in batches:
            rows = []
            for i, f, text in zip(*(batch.column(c).to_pylist() for c in ("id", "f", "text"))):
                needs: dict[int, int] = {}
                for line, _, _, need in scanner.conditional_spans(text):
                    needs[line] = min(need, needs.get(line, need))
                rows += [(i, f, line, need) for line, need in needs.items()]
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "f", "line_no", "need"])

    found = _rows(chunks, id_col, text_col).mapInArrow(scan, "id bigint, f bigint, line_no int, need int")
    return _with_paths(found, files).where(_fits(F.col("need"), F.col("path"))).select("id", "line_no").distinct()


def redacted(chunks: DataFrame, files: DataFrame, id_col: str = "chunk_id", text_col: str = "text", checksums: bool = False) -> DataFrame:
    """(id, n_spans, redacted_text) of every chunk that holds a credential; its other text is unchanged.

    Rows are taken as by ``secret_lines``; repeated rows give repeated rows. Only texts in
    which something was found leave the scan.
    """
    span = "array<struct<line:int,start:int,stop:int,need:int>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(checksums)
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("line", "start", "stop", "need")]))
        for batch in batches:
            rows = []
            for i, f, text in zip(*(batch.column(c).to_pylist() for c in ("id", "f", "text"))):
                spans = scanner.conditional_spans(text)
                if spans:
                    rows.append((i, f, text, [dict(zip(("line", "start", "stop", "need"), s)) for s in spans]))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "f", "text", "spans"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            new = [blank(t, [(s["line"], s["start"], s["stop"]) for s in x]) for t, x in zip(batch.column("text").to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(map(len, spans), pa.int32()), pa.array(new, pa.string())], names=["id", "n_spans", "redacted_text"]
            )

    found = _rows(chunks, id_col, text_col).mapInArrow(scan, f"id bigint, f bigint, text string, spans {span}")
    placed = _with_paths(found, files)
    placed = placed.select("id", "text", F.filter("spans", lambda s: _fits(s["need"], F.col("path"))).alias("spans")).where(F.size("spans") > 0)
    return placed.mapInArrow(fill, "id bigint, n_spans int, redacted_text string")
