"""Secret scans: candidates by pattern, false positives removed by a random forest, within each row.

Candidates are private key blocks, long runs of token characters with a digit, quoted values after
`=` or `:`, unquoted values of 8 characters or more assigned to a secret word, keys with a known
prefix, signed web tokens, and the passwords of URLs. The forest is trained from labelled findings (a generated set with the usual shapes of secrets and of
what only looks like them, or the caller's own) on length, character transitions, dictionary
coverage, path and neighbouring words. Its trees are then written as nested CASE expressions, so
that all candidates of a text are scored inside its row by native expressions and nothing is
shuffled, however many secrets one text or source has.

The neighbouring words of a candidate are those that begin within `LEFT` characters before it or
`RIGHT` after it, other candidates included; text farther away says nothing about it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: How keys of known services begin, with what follows.
PREFIXED = (
    r"(?:A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[opsur]_[A-Za-z0-9]{16,}+|github_pat_\w{16,}+|glpat-[\w-]{16,}+|xox[abeoprs]-[\w-]{8,}+"
    r"|sk-[\w-]{16,}+|[prs]k_(?:live|test)_[A-Za-z0-9]{8,}+|AIza[\w-]{30,}+|npm_[A-Za-z0-9]{30,}+|hf_[A-Za-z0-9]{20,}+"
    r"|key-[0-9a-f]{32}(?![0-9a-f])|[AS][CK][0-9a-f]{32}(?![0-9a-f])"
    r"|SG\.[\w-]{16,}+\.[\w-]{16,}+|eyJ[\w-]{8,}+\.[\w-]{4,}+\.[\w-]{8,}+)"
)
#: A private key with its lines, also where its end is missing or line feeds are escaped.
_GAP = r"(?:\s|\\[nr])*+"
KEY_BLOCK = (
    rf"-----BEGIN (?:[A-Z0-9]{{2,12}} )?PRIVATE KEY(?: BLOCK)?-----(?:{_GAP}(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*+)*+"
    rf"(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)*+(?:{_GAP}[A-Za-z0-9+/=]*+{_GAP}-----END [A-Z0-9 ]{{0,30}}-----)?+"
)
#: What is published and looks like one: certificates, public keys, also on one line.
PUBLIC_BLOCK = (
    rf"-----BEGIN (?:[A-Z0-9]{{2,12}} ){{0,3}}(?:CERTIFICATE|PUBLIC KEY|CERTIFICATE REQUEST)(?: BLOCK)?-----(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)*+"
    rf"(?:{_GAP}[A-Za-z0-9+/=]*+{_GAP}-----END [A-Z0-9 ]{{0,30}}-----)?+"
)
#: Names that say what an assigned value is.
NAMED = "token|secret|pass|pwd|api.?key|access.?key|auth|bearer|credential|private"
#: A URL up to its password.
USER = r"""://[^\s:/@"']{0,40}:"""
CANDIDATE = (
    rf"{KEY_BLOCK}|{PUBLIC_BLOCK}|"
    rf"""(?<=>)(?<=<[A-Za-z0-9_:.-]{{0,16}}(?i:{NAMED})[A-Za-z0-9_.-]{{0,16}}>)[^\s<>"']{{8,}}+(?=</)|"""
    rf"""(?<=is:? )(?<=(?i:pass(?:word|phrase|code)?|secret|token) (?:\w{{1,8}} )?is:? )(?=[^\s"']*[^A-Za-z\s"'.,;:!?)])[^\s"']{{8,}}(?<![.,;:!?)\]}}>])|"""
    rf"(?<=[=:] ?)(?<=(?i:{NAMED})[A-Za-z0-9_.-]{{0,16}}[\"']? ?[=:] ?)"
    r"""(?![A-Za-z][A-Za-z0-9+.-]*+://)[^\s"']{8,}(?<![.,;:!?)\]}>])"""
    r"""|(?<=[psd][ =])(?<=\s-{1,2}p(?:ass(?:word|wd)?)?[ =])(?!-)[^\s"'=]{8,}"""
    rf"""|(?<=:)(?<={USER})[^\s/"']+(?=@)"""
    rf"|(?<![A-Za-z0-9]){PREFIXED}"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+"
    r"""(?:={1,2}(?![A-Za-z0-9_+/=$-]|["'][^\s"',;:)\]}>.]))?"""  # padding, not an assignment
    r"""|(?<=[=:] ?["'])[^\s"']{8,}+(?=["'])"""
)
LEFT, RIGHT = 48, 16
TREES, DEPTH, SEED, LABELLED, THRESHOLD = 15, 6, 11, 7_000, 0.5
MARK = "[secret]"

#: Words that make up ordinary identifiers, frequent letter pairs, neighbouring words.
WORDS = (
    "account address annual array backup build cache change check class client code column config count create data date "
    "default delete demo document dummy error example fetch field file final first folder format function group handle header "
    "here hidden image index input insert item label last layout level list load local main message method model module name "
    "node number object option order output page parse path placeholder print process project query record release report "
    "request result row sample schema screen search select server session set size sort source start state status string "
    "table target template test text time title token type update upload user utils value version view width word write your replace with key"
)
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch"
SECRET_WORDS = r"(?i)token|secret|pass(?:[wp]|code)|(?<![a-z])pass(?:\b|_|[^a-z])|pwd|api.?key|access.?key|auth|bearer|credential|private|signature|\bsig=|hooks?[./]|\s-p $"
PLAIN_WORDS = r"(?i)base64,|integrity|commit|sha\d|md5|checksum|digest|hash|uuid|guid|isbn|phone|tel|card|order|invoice|ticket|revision|rev\b|blob\s|tree|build|etag|trace|span|class=|style|ssh-|ecdsa-"
#: Values that say themselves that they are published.
PLAIN_VALUES = r"^(?:sha|md)\d+[-:_]|^data:[a-z]+/|^AAAA[A-Z]3NzaC|^-----BEGIN (?![A-Z0-9 ]{0,40}PRIVATE)"
FEATURES = (
    "length", "transitions", "digits", "distinct", "hex", "letter_pairs", "dictionary", "path", "secret_word", "assigned",
    "plain_word", "quoted", "repeat_char", "prefix", "url_password", "key_block", "code",
)


def features(value: Column, left: Column, right: Column) -> Column:
    """The values of `FEATURES` as an array of doubles."""
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    low = F.lower(value)
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("double")
    known = F.regexp_replace(low, "|".join(sorted(WORDS.split(), key=len, reverse=True)), "")
    return F.array(
        size,
        count(value, r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]") / size,
        count(value, "[0-9]") / size,
        F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(16.0)),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        count(low, "(?=" + "|".join(PAIRS.split()) + ")") / size,
        1.0 - F.length(known) / size,
        flag(F.concat(left, value).rlike(r"(?i)(?:://|www\.|/)[^\s\"']*$") & ~left.rlike(r"[=:]\s?[\"']?$")),
        flag(left.rlike(SECRET_WORDS)),
        flag(left.rlike(r"[=:>]\s?[\"']?$|(?i)bearer $|\s-p $|(?i)\bis:? $")),
        flag(left.rlike(PLAIN_WORDS) | right.rlike(PLAIN_WORDS) | value.rlike(PLAIN_VALUES)),
        flag(left.rlike("[\"']$")),
        flag(value.rlike(r"(?i)(.)\1{4}|0123|1234|abcd")),
        flag(value.rlike(f"^{PREFIXED}")),
        flag(left.rlike(f"{USER}$")),
        flag(value.rlike("^-----BEGIN [A-Z0-9 ]{0,40}PRIVATE")),
        flag(value.rlike(r"^[\[({<$%]|^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+|\w\(")),
    )


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """`n` generated findings: value, left, right, label (1.0 a secret); the same ones each time."""
    i = F.col("id")
    pick = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(xs))) + 1).cast("int"))
    number = lambda salt, lo, hi: (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(hi - lo + 1)) + lo).cast("int")
    sha = F.sha1(F.concat(F.lit("f"), i.cast("string")))
    mixed = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("g"), i.cast("string")), 256))), "=+/", "aB7")
    plain = F.translate(mixed, "+/", "xY")
    number_text = F.lpad(F.pmod(F.xxhash64(F.lit("d"), i), F.lit(10**16)).cast("string"), 16, "4")
    some = F.array(*(pick(f"w{k}", *WORDS.split()) for k in range(3)), number("y", 1, 2030).cast("string"))
    words = F.when(number("sep", 0, 1) == 0, F.array_join(some, "_")).otherwise(F.array_join(some, "-"))
    prose = pick("prose", "and then the ", "of this in ", "the wind was ", "les deux que ", "und der ", "por la ")
    name = pick("name", "token", "secret", "api_key", "apikey", "password", "passwd", "access_token", "auth_token", "TOKEN", "SECRET_KEY", "client_secret", "private_key")
    join, quote = pick("join", " = ", "=", ": ", ":"), pick("quote", '"', "'", '"')
    uuid = F.concat_ws("-", *(F.substring(sha, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    hexes = F.when(number("up", 0, 3) == 0, F.upper(F.substring(sha, 1, 40))).otherwise(F.substring(F.concat(sha, F.md5(sha)), F.lit(1), pick("hl", 32, 40, 40, 64)))
    empty = F.lit("")
    letters = lambda c: F.translate(c, "0123456789", "ghijkmnpqr")
    stem = pick("st", "hunter", "Tr0ub4dor", "dragon", "S3cr3t", "Winter", "monkey", "sunshine", "correct", "Pa55w0rd", "blueberry")
    human = F.concat(stem, pick("sy", "", "&", "!", "#", "", "-", "@"), number("hu", 1, 99).cast("string"), pick("en", "x", "!", "Pw", "hunter2", "Rain", "$9"))
    human = F.when(F.length(human) < 8, F.concat(human, F.lit("Kq7"))).otherwise(human)
    secret_name = F.concat(pick("sn", "", "db_", "my_", "DB_"), name)
    site = F.concat(pick("sch", "postgres://", "https://", "mysql://", "redis://", "amqp://"), pick("us", "u", "admin", "user", "app", ""), F.lit(":"))
    part = lambda a, n: F.substring(plain, a, n)
    keys = F.concat(
        pick("px", "ghp_", "sk-", "xoxb-", "glpat-", "npm_", "hf_", "sk_live_", "rk_live_", "AIza", "github_pat_"),
        F.when(number("kd", 0, 2) == 0, letters(part(1, 40))).otherwise(part(1, 40)),
    )
    slack = F.concat(pick("xo", "xoxb-", "xoxp-", "xoxa-"), F.lpad(F.abs(F.xxhash64(F.lit("s1"), i)).cast("string"), 12, "7"), F.lit("-"), F.lpad(F.abs(F.xxhash64(F.lit("s2"), i)).cast("string"), 12, "3"), F.lit("-"), part(1, 24))
    web = F.concat(F.lit("eyJhbGciOiJ"), part(3, 12), F.lit("."), pick("wb", "eyJzdWIiOiI", "eyJpc3MiOiJ", "eyJ1c2VyIjoi"), part(9, 18), F.lit("."), part(1, 43))
    mail = F.concat(F.lit("SG."), part(1, 22), F.lit("."), part(1, 43))
    block = F.concat(F.lit("-----BEGIN "), pick("pk", "RSA ", "EC ", ""), F.lit("PRIVATE KEY-----\n"), F.repeat(F.concat(mixed, F.lit("\n")), number("bl", 1, 9)), F.lit("-----END PRIVATE KEY-----"))
    capital = F.upper(F.translate(part(1, 16), "0189", "BCDE"))
    lead = lambda salt: pick(salt, "", "", "key ", "use ", "the ", "    ", "  - ", "// ", "# note ", "id ", "curl -H ", "x=")
    syllables = F.transform(F.sequence(F.lit(1), number("sl", 5, 8)), lambda k: F.element_at(F.array(*map(F.lit, "ba co du fi gra hel jan ko lu mer no pra qui ro sto tun vel wa xi zen".split())), (F.pmod(F.xxhash64(F.lit("sy"), i, k), F.lit(20)) + 1).cast("int")))
    strange = F.call_function("array_join", syllables, pick("sj", "", "_", "/", "-"))
    strange = F.concat(F.when(F.length(strange) < 15, F.concat(strange, F.lit("manurestovelu"))).otherwise(strange), number("sd", 1, 99).cast("string"))
    plain_text = pick("pt", "required", "everything", "available", "following", "necessary", "something", "mandatory", "undefined", "optional", "generated", "forgotten", "therefore")
    reference = pick("rf", "settings.", "config.", "os.environ.", "self.", "process.env.", "${", "<your_", "{{")
    reference = F.concat(reference, pick("r1", "get_token()", "DB_PASSWORD", "api_key", "secret_key", "password", "access_token", "token_value"))
    strong = F.concat(F.translate(part(3, 6), "aeiou", "!#@7$"), number("st", 10, 99).cast("string"), part(20, 5))
    public = F.concat(F.lit("-----BEGIN "), pick("pb", "CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST"), F.lit("-----\n"), F.repeat(F.concat(mixed, F.lit("\n")), number("bl", 1, 9)), F.lit("-----END CERTIFICATE-----"))
    short_name = pick("sm", "smtp_pass", "pass", "DB_PASS", "ftp_pass", "user.pass", "redis_pass", "admin-pass", "passphrase", "keystore_pass")
    element = pick("xe", "password", "Password", "db-password", "apiKey", "secret", "pass", "authToken", "client_secret")
    secret_value = F.when(number("sv", 0, 2) == 0, human).when(number("sv", 0, 2) == 1, strong).otherwise(F.substring(plain, F.lit(1), number("n", 9, 30)))
    shapes = [
        (1.0, secret_value, F.concat(pick("pr", "", "and the ", "  ", "export "), short_name, join), empty),
        (1.0, secret_value, F.concat(pick("pr", "", "and the ", "  ", "export "), short_name, join, quote), quote),
        (1.0, secret_value, F.concat(pick("xp", "", "<db><user>u</user>", "    "), F.lit("<"), element, F.lit(">")), F.concat(F.lit("</"), element, F.lit(">"))),
        (1.0, secret_value, F.concat(pick("pi", "the ", "my ", "its ", "The vpn "), pick("pj", "password", "passphrase", "passcode", "token", "secret"), pick("pk2", " is ", " is: ", " now is ")), pick("pl", "", " for now", " on staging")),
        (0.0, F.concat(pick("du", "data:image/png;base64,", "data:image/svg+xml;base64,", "data:font/woff2;base64,", "data:application/pdf;base64,"), mixed, mixed), F.concat(pick("dv", '<img src="', "<a href='", 'url("', '"icon": "', 'src="')), pick("dw", '"', "'", '" alt="x"')),
        (0.0, F.concat(pick("sk2", "AAAAB3NzaC1yc2EAAAADAQABAAABgQC", "AAAAC3NzaC1lZDI1NTE5AAAAI", "AAAAE2VjZHNhLXNoYTItbmlzdHAyNTYAAAAI"), mixed, mixed), pick("sl2", "ssh-rsa ", "ssh-ed25519 ", "ecdsa-sha2-nistp256 ", "key: ssh-rsa "), pick("sm2", " me@host", " deploy", "", "= root@box")),
        (0.0, public, lead("kl"), empty),
        (0.0, plain_text, F.concat(pick("pi", "the ", "my ", "its ", "The vpn "), pick("pj", "password", "passphrase", "passcode", "token", "secret"), F.lit(" is ")), empty),
        (0.0, F.concat(pick("w0", *WORDS.split()), pick("xo2", "-", "_", ""), pick("w1", *WORDS.split()), number("y", 1, 9).cast("string")), F.concat(F.lit("<"), pick("xn", "name", "title", "passenger", "compass", "path", "class"), F.lit(">")), F.lit("</")),
        (0.0, F.concat(pick("w0", *WORDS.split()), pick("xo2", "-", "_", ""), pick("w1", *WORDS.split()), pick("w2", *WORDS.split())), F.concat(pick("pg", "passenger", "passing", "compass", "bypass", "passport", "pass_count", "boarding pass", "day pass", "mountain pass"), join), empty),
        (1.0, hexes, F.concat(prose, name, join, quote), quote),
        (1.0, F.substring(plain, F.lit(1), number("n", 20, 43)), F.concat(prose, name, join, quote), quote),
        (1.0, F.substring(plain, F.lit(1), number("n", 20, 43)), F.concat(name, join), empty),
        (1.0, hexes, F.concat(F.upper(name), F.lit(" = "), quote), quote),
        (1.0, F.substring(plain, F.lit(1), number("n", 9, 18)), F.concat(pick("pw", "password", "passwd", "pwd"), join, quote), quote),
        (1.0, F.substring(plain, F.lit(1), number("n", 28, 43)), pick("be", "Authorization: Bearer ", "auth: Bearer ", "bearer "), empty),
        (1.0, human, F.concat(pick("pr", "", "and the ", "export "), secret_name, join), empty),
        (1.0, letters(F.substring(plain, F.lit(1), number("n", 12, 30))), F.concat(secret_name, join), empty),
        (1.0, F.concat(F.lit("AKIA"), F.when(number("ad", 0, 1) == 0, capital).otherwise(F.upper(letters(F.substring(sha, 1, 16))))), F.when(number("al", 0, 1) == 0, lead("kl")).otherwise(pick("ak", "", "aws_key=", "id: ", "access_key_id = ")), empty),
        (1.0, keys, lead("kl"), empty),
        (1.0, slack, lead("kl"), empty),
        (1.0, web, F.when(number("wl", 0, 1) == 0, lead("kl")).otherwise(pick("be", "Authorization: Bearer ", "auth: Bearer ", "session=")), empty),
        (1.0, mail, lead("kl"), empty),
        (1.0, block, lead("kl"), empty),
        (1.0, F.concat(pick("ky", "key-", "SK", "AC"), F.substring(sha, 1, 32)), lead("kl"), empty),
        (1.0, F.concat(F.upper(F.substring(plain, 1, 9)), F.lit("/"), pick("wh", "B", "C", "D"), F.upper(F.substring(plain, 10, 8)), F.lit("/"), F.substring(plain, 18, 24)), pick("wu", "https://hooks.host.example/services/", "post to https://hooks.host.example/", "url: https://host.example/api/webhooks/"), empty),
        (1.0, F.substring(plain, F.lit(1), number("n", 28, 43)), pick("sg", "https://host.example/c?sv=20&sig=", "?expires=17&signature=", "&X-Signature="), pick("se", "", "%3D", "&x=1")),
        (1.0, F.when(number("hq", 0, 1) == 0, human).otherwise(F.substring(plain, F.lit(1), number("n", 9, 18))), pick("cl", "mysql -u root -p ", "tool --password ", "sshpass -p ", "run --pass ", "cli --password="), pick("ce2", " db", "", " host")),
        (0.0, F.concat(pick("w0", *WORDS.split()), F.lit("/"), pick("w1", *WORDS.split()), F.lit("-"), number("y", 1, 2030).cast("string"), F.lit("/part-"), F.substring(number_text, 1, 5)), pick("bu", "s3://", "gs://bucket/", "hdfs://host/", "see "), pick("bx", ".parquet", ".gz", "")),
        (0.0, F.concat(pick("cs", "css-", "sc-", "jss", "mui-", "v-"), F.lower(F.substring(plain, 1, 10))), pick("ct", 'class="', "className='", 'id="', 'data-v="'), pick("cq", '"', "' ")),
        (0.0, F.substring(sha, F.lit(1), pick("hl", 32, 40, 40, 32)), pick("et", 'ETag: "', 'etag="', "trace_id=", "span ", 'version="', "?v=", 'x-request-id: "', "@sha256:"), pick("eq", '"', "", " ")),
        (0.0, F.concat(pick("w0", *WORDS.split()), F.lit("-"), F.substring(sha, 1, 10), F.lit("-"), F.substring(letters(sha), 1, 5)), pick("po", "pod ", "logs ", "container ", "job "), empty),
        (1.0, F.concat(mixed, F.substring(mixed, 1, 40), F.lit("==")), pick("ac", "AccountKey=", "SharedAccessKey=", "secret_key: ", "PRIVATE_KEY="), empty),
        (1.0, F.concat(F.initcap(pick("p1", "bacon", "dufi", "gralon", "helio", "janko")), pick("p2", "!", "-", "_", "#", "", "."), pick("p3", "lumer", "Pravel", "quist", "rostov", "Tunwel"), number("p4", 1, 9999).cast("string")), F.concat(pick("pr", "", "and the ", "export "), secret_name, join), empty),
        (0.0, strange, F.concat(prose, pick("ur", "https://host.example/docs/", "/usr/share/", "see ", "the file ", "call ", "import ", "")), empty),
        (0.0, F.concat(F.replace(F.initcap(F.call_function("array_join", F.array(*(pick(f"c{k}", "bacon", "dufi", "gral", "helio", "janko", "lumer", "pravel", "quist", "rostov", "tunwel") for k in range(3))), F.lit(" "))), F.lit(" "), F.lit("")), number("sd", 1, 99).cast("string")), F.concat(prose, pick("ci", "the class ", "import ", "call ", "see ", "new ", "")), pick("ce", "", "()", ".")),
        (0.0, sha, F.concat(prose, pick("cm", "see ", "merged in ", "at ", "")), pick("cn", "", " on the branch", ".", " in the log")),
        (0.0, F.concat(mixed, mixed), pick("da", "url(data:image/png;base64,", "src=data:font/woff2;base64,", "data:image/jpeg;base64,"), pick("de", ")", "", '"')),
        (0.0, F.concat(pick("ig", "sha512-", "sha256-", "sha384-"), mixed, F.substring(mixed, 1, 20), F.lit("==")), pick("il", '"integrity": "', "integrity ", "integrity='"), pick("ie", '"', "", "'")),
        (0.0, F.concat(pick("gv", "os.getenv(", "System.getenv(", "getpass.getpass(", "vault.read(", "env(", "config.get("), empty), F.concat(pick("pr", "", "and the ", "export "), secret_name, join), pick("gq", "'", '"')),
        (1.0, human, F.concat(pick("db", "", "DATABASE_URL=", "at ", "url: "), site), F.lit("@db.example/main")),
        (1.0, F.substring(plain, F.lit(1), number("n", 9, 22)), F.concat(pick("db", "", "DATABASE_URL=", "at ", "url: "), site), pick("ds", "@db.example:5432/main", "@cache:6379", "@host.example/x")),
        (0.0, plain_text, F.concat(prose, secret_name, pick("j2", ": ", "=", " = ", ":")), pick("e2", "", " by the", ".")),
        (0.0, reference, F.concat(pick("pr", "", "and the ", "export "), secret_name, join), pick("e3", "", ",", ")")),
        (0.0, pick("up", "${DB_PASSWORD}", "<password>", "{password}", "PASSWORD", "password", "your_password"), F.concat(pick("db", "", "DATABASE_URL=", "at ", "url: "), site), F.lit("@db.example/main")),
        (0.0, F.concat(pick("px", "sk-", "hf_", "npm_"), F.array_join(F.array(*(pick(f"w{k}", *WORDS.split()) for k in range(4))), "-")), prose, empty),
        (0.0, F.concat(pick("vn", "AWS_S3_", "DB2_", "APP_V2_", "OAUTH2_", "K8S_", "S3_"), F.upper(name), pick("ve", "_ACCESS_KEY", "_NAME", "_VALUE", "")), pick("vl", "", "export ", "set ", "the "), pick("vr", '="', " = ", "=", ": ")),
        (0.0, sha, F.concat(prose, pick("vc", "commit ", "sha1 ", "revision ", "tree ", "blob ", "checksum: ", "md5: ")), pick("e", "", " on main", ".")),
        (0.0, number_text, F.concat(prose, pick("nn", "", "order ", "card ", "ticket ", "invoice: ")), empty),
        (0.0, words, F.concat(prose, pick("ur", "https://host.example/docs/", "/usr/share/", "see ", "the file ", "call ")), empty),
        (0.0, F.concat(pick("ph", "your_", "example-", "sample_", "dummy_", "placeholder-", "test_"), words), F.concat(prose, name, join, quote), quote),
        (0.0, uuid, F.concat(prose, pick("id", "uuid ", "guid: ", "record id=", "request ", "")), empty),
        (0.0, words, F.concat(pick("nm", "name", "title", "path", "label", "file"), join, quote), quote),
        (0.0, F.concat(F.repeat(pick("x", "x", "0", "*", "a"), number("rl", 14, 30)), number("z", 1, 9).cast("string")), F.concat(name, join, quote), quote),
        (0.0, number_text, F.concat(pick("k", "id", "count", "phone", "number"), join), empty),
    ]
    size = len(shapes)

    def some_shapes(first: int, last: int) -> DataFrame:
        """The findings of a part of the shapes, as all of them in one projection are too much code to compile."""
        kind = F.pmod(i, F.lit(size))
        of = lambda k: F.coalesce(*(F.when(kind == j, s[k] if k else F.lit(s[0])) for j, s in enumerate(shapes) if first <= j < last))
        rows = spark.range(0, n, 1, 1).filter((kind >= first) & (kind < last))
        return rows.select(of(1).alias("value"), of(2).alias("left"), of(3).alias("right"), of(0).alias("label"))

    return reduce(DataFrame.unionByName, (some_shapes(a, min(a + 4, size)) for a in range(0, size, 4)))


def train(spark: SparkSession, findings: DataFrame | None = None) -> list[str]:
    """The trees of a forest fitted on labelled findings (value, left, right, label), as Spark describes them.

    Null values and neighbours count as empty and rows without a label are left out; without any row
    there is no tree, and every candidate scores 0. Repeated rows weigh as often as they stand.
    """
    rows = labelled_findings(spark) if findings is None else findings
    value, left, right = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in ("value", "left", "right"))
    x = rows.select(rows["label"].cast("double").alias("label"), array_to_vector(features(value, left, right)).alias("features"))
    x = stored(x.filter("label is not null").coalesce(1), "findings")
    if x.isEmpty():
        return []
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(x)
    return [t.toDebugString for t in model.trees]


def vote(tree: str, x: Column) -> Column:
    """A described tree as nested CASE expressions over the array `x`: 1.0 or 0.0."""
    lines = [line.strip() for line in tree.splitlines()[1:] if line.strip()]

    def node() -> Column:
        line = lines.pop(0)
        if m := re.match(r"Predict: ([\d.]+)", line):
            return F.lit(float(m[1]))
        m = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line)
        yes = node()
        assert lines.pop(0).startswith("Else")
        return F.when(x[int(m[1])] <= float(m[2]), yes).otherwise(node())

    return node()


def scan(docs: DataFrame, trees: list[str], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_candidates, findings, redacted, then the columns of `keep`.

    findings lists what the forest holds for secrets (start in code points from 0, length, score);
    in redacted each is replaced by `MARK`. A null text has no findings and stays null, an empty
    one stays empty. Repeated rows and null ids are scanned like any other; an empty table gives
    an empty one; other columns are ignored.
    """
    text = docs[text_col].cast("string")
    d = docs.select(
        docs[id_col].alias("doc_id"), text.alias("text"), F.struct(*(docs[c] for c in keep)).alias("kept") if keep else F.lit(0).alias("kept"),
        F.coalesce(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.array().cast("array<string>")).alias("found"),
    )
    between = F.when(F.size("found") > 0, F.split("text", CANDIDATE, -1)).otherwise(F.array(F.coalesce("text", F.lit(""))))
    d = d.withColumn("between", between)
    # a candidate and what is needed around it have 6 characters or more: so many pieces hold the context
    before, after = LEFT // 6, RIGHT // 6 + 1

    def pieces(at: Column, n: Column, size: int, cut) -> Column:
        """Texts between candidates with the candidate that follows each, joined from piece `at`."""
        joined = F.zip_with(F.slice("between", at + 1, n), F.slice("found", at + 1, n), lambda b, v: F.concat(cut(b, F.lit(size)), cut(F.coalesce(v, F.lit("")), F.lit(size))))
        return F.array_join(joined, "")

    def around(v: Column, i: Column) -> Column:
        first = F.greatest(i - before, F.lit(0))
        left = F.concat(pieces(first, i - first, LEFT, F.right), F.right(F.get("between", i), F.lit(LEFT)))
        right = pieces(i + 1, F.lit(after + 1), RIGHT, F.left)
        return F.struct(v.alias("value"), F.right(left, F.lit(LEFT)).alias("left"), F.left(right, F.lit(RIGHT)).alias("right"))

    seen = F.transform("found", around)
    d = d.withColumn("x", F.transform(seen, lambda c: features(c.value, c.left, c.right)))

    def share(x: Column) -> Column:
        total = F.lit(0.0)
        for t in trees:
            total = total + vote(t, x)
        return total / float(max(1, len(trees)))

    d = d.withColumn("scores", F.transform("x", share))
    is_secret = lambda i: F.get("scores", i) >= THRESHOLD
    # offsets by sums inside runs of about sqrt(n) pieces and over whole runs before them
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.size("found")
    d = d.withColumn("lengths", F.zip_with("between", "found", lambda b, v: (F.length(b) + F.coalesce(F.length(v), F.lit(0))).cast("long")))
    d = d.withColumn("run", F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int"))
    runs = F.sequence(F.lit(0), F.floor(n / F.col("run")).cast("int"))
    d = d.withColumn("sums", F.transform(runs, lambda r: total(F.slice("lengths", r * F.col("run") + 1, F.col("run")))))
    d = d.withColumn("before", F.transform(runs, lambda r: total(F.slice("sums", F.lit(1), r))))

    def placed(v: Column, i: Column) -> Column:
        r = F.floor(i / F.col("run")).cast("int")
        inside = total(F.slice("lengths", r * F.col("run") + 1, i - r * F.col("run")))
        start = F.get("before", r) + inside + F.length(F.get("between", i))
        return F.when(
            is_secret(i),
            F.struct(start.cast("bigint").alias("start"), F.length(v).cast("bigint").alias("length"), F.get("scores", i).alias("score")),
        )

    marks = F.filter(F.transform("found", placed), lambda m: m.isNotNull())
    none = F.array().cast("array<struct<start:bigint,length:bigint,score:double>>")
    shown = F.transform("found", lambda v, i: F.when(is_secret(i), F.lit(MARK)).otherwise(v))
    rebuilt = F.array_join(F.transform("between", lambda b, i: F.concat(b, F.coalesce(F.get(shown, i), F.lit("")))), "")
    any_secret = F.exists("scores", lambda s: s >= THRESHOLD)
    return d.select(
        "doc_id",
        F.size("found").cast("long").alias("n_candidates"),
        F.when(any_secret, marks).otherwise(none).alias("findings"),
        F.when(any_secret, rebuilt).otherwise(F.col("text")).alias("redacted"),
        *(F.col(f"kept.{c}").alias(c) for c in keep if c != "doc_id"),
    )
