"""Findings for judging the secret scan, made apart from its trainer: random strings from Python's generator, other
names, other sentences and other hosts. Each shape gives (text, value), value None for what only looks like a secret."""

import base64
import random
import string

LETTERS, UPPER, DIGITS = string.ascii_letters, string.ascii_uppercase, string.digits
URLSAFE = LETTERS + DIGITS + "-_"
AROUND = ("Please rotate {} before Friday.", "{}", "    {}\n", "config:\n  - {}\nend", "// {}", "we found {} in the log", "curl -s {} | sh", "# note {} (old)")
#: Words of this list only, so that passwords and identifiers aren't the trainer's.
NOUNS = "otter maple quartz lantern violet harbor saddle cobalt meadow pepper raven tundra walnut zephyr marble".split()


def some(rng, n, alphabet=LETTERS + DIGITS):
    return "".join(rng.choice(alphabet) for _ in range(n))


def spot(rng, text):
    return rng.choice(AROUND).format(text)


def password(rng, n=10):
    while True:
        p = some(rng, n, LETTERS + DIGITS + "!@#$%^&*")
        if any(c.isdigit() for c in p) and any(c.islower() for c in p) and any(c.isupper() for c in p):
            return p


def phrase(rng):
    return rng.choice(NOUNS).capitalize() + rng.choice("!#-_&") + rng.choice(NOUNS) + some(rng, 2, DIGITS)


def jwt(rng):
    part = lambda d: base64.urlsafe_b64encode(d.encode()).decode().rstrip("=")
    return f"{part('{"alg":"HS256","typ":"JWT"}')}.{part('{"sub":"%s","iat":%s}' % (some(rng, 9), some(rng, 10, DIGITS)))}.{some(rng, 43, URLSAFE)}"


def pem(rng):
    kind = rng.choice(("RSA ", "EC ", "OPENSSH ", ""))
    lines = "\n".join(some(rng, 64, LETTERS + DIGITS + "+/") for _ in range(rng.randint(3, 12)))
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n{some(rng, 22)}==\n-----END {kind}PRIVATE KEY-----"


def whole(make):
    def shape(rng):
        v = make(rng)
        return spot(rng, v), v

    return shape


def given(form, make):
    def shape(rng):
        v = make(rng)
        return spot(rng, rng.choice(form).format(v)), v

    return shape


def looks(form, make):
    return lambda rng: (spot(rng, rng.choice(form).format(make(rng))), None)


SECRETS = {
    "bare ghp token": whole(lambda r: "ghp_" + some(r, 36)),
    "token with ghp": given(("token: {}", "GITHUB_TOKEN={}", "git clone https://x-access-token:{}@github.example/a.git"), lambda r: "ghp_" + some(r, 36)),
    "stripe": given(("STRIPE_KEY={}", "stripe.api_key = '{}'", "{}"), lambda r: r.choice(("sk_live_", "rk_live_")) + some(r, 24)),
    "slack": given(("SLACK={}", "{}", "slack token {}"), lambda r: f"xoxb-{some(r, 12, DIGITS)}-{some(r, 12, DIGITS)}-{some(r, 24)}"),
    "unquoted password": given(("password={}", "DB_PASSWORD={}", "passwd: {}", "pwd={}"), password),
    "passphrase": given(("password={}", "MYSQL_ROOT_PASSWORD={}", "password: {}"), phrase),
    "url password": given(("postgres://admin:{}@db.internal:5432/app", "mongodb+srv://svc:{}@cluster0.example.net/x", "redis://:{}@cache:6379"), lambda r: some(r, r.randint(9, 20))),
    "aws id": given(("{}", "aws_access_key_id = {}", "id {}"), lambda r: "AKIA" + some(r, 16, UPPER + "234567")),
    "aws secret": given(("aws_secret_access_key = {}", 'AWS_SECRET_ACCESS_KEY="{}"', "secret_key: {}"), lambda r: some(r, 40, LETTERS + DIGITS + "+/")),
    "jwt bearer": given(("Authorization: Bearer {}", "-H 'Authorization: Bearer {}'"), jwt),
    "bare jwt": given(("{}", "cookie session={}", "jwt {}"), jwt),
    "quoted password": given(('password = "{}"', "'password': '{}'", '"pwd": "{}"'), lambda r: password(r, r.randint(9, 16))),
    "quoted hex": given(('token = "{}"', 'api_key: "{}"', "secret='{}'"), lambda r: some(r, r.choice((32, 40, 64)), "0123456789abcdef")),
    "env api key": given(("API_KEY={}", "export ACME_API_KEY={}", "apikey: {}", "X-Api-Key: {}"), lambda r: some(r, r.randint(24, 40))),
    "key block": whole(pem),
    "google": whole(lambda r: "AIza" + some(r, 35, URLSAFE)),
    "gitlab": given(("{}", "PRIVATE-TOKEN: {}"), lambda r: "glpat-" + some(r, 20, URLSAFE)),
    "sendgrid": whole(lambda r: f"SG.{some(r, 22, URLSAFE)}.{some(r, 43, URLSAFE)}"),
    "storage key": given(("AccountKey={};EndpointSuffix=core", "AccountName=a;AccountKey={}"), lambda r: some(r, 86, LETTERS + DIGITS + "+/") + "=="),
}

HEX = "0123456789abcdef"
PLAIN = {
    "commit": looks(("commit {}", "merged in {}", "see {} on the branch", "revision {}"), lambda r: some(r, 40, HEX)),
    "uuid": looks(("id {}", "request-id: {}", "uuid={}"), lambda r: "-".join(some(r, k, HEX) for k in (8, 4, 4, 4, 12))),
    "checksum": looks(("md5: {}", "sha256sum {}", "digest {}"), lambda r: some(r, r.choice((32, 64)), HEX)),
    "integrity": looks(('"integrity": "sha512-{}"',), lambda r: some(r, 86, LETTERS + DIGITS + "+/") + "=="),
    "path": looks(("/var/lib/{}/data", "see docs/{}/readme.md", "https://files.example.org/{}/a.html"), lambda r: "/".join(r.sample(NOUNS, 3)) + some(r, 2, DIGITS)),
    "identifier": looks(("call {}()", "the class {}", "import {}"), lambda r: "".join(w.capitalize() for w in r.sample(NOUNS, 3)) + some(r, 1, DIGITS)),
    "snake": looks(("rename {}", "{} = 4", "def {}(x):"), lambda r: "_".join(r.sample(NOUNS, 3)) + "_v2"),
    "number": looks(("order {}", "invoice {}", "card {}", "phone: {}"), lambda r: some(r, 16, DIGITS)),
    "placeholder": looks(('password = "{}"', "API_KEY={}", "token: {}"), lambda r: r.choice(("your-password-here", "<insert-token>", "changeme-example", "xxxxxxxxxxxxxxxx", "example_token_1", "${SECRET_TOKEN}", "REPLACE_WITH_KEY_1"))),
    "prose": looks(("the password: {} for all users", "a token: {} value", "its secret: {}"), lambda r: r.choice(("mandatory", "sometimes", "whatever you like", "described below", "temporary", "confidential"))),
    "reference": looks(("password=os.getenv('{}')", "token = self.{}", "secret: settings.{}"), lambda r: "_".join(r.sample(NOUNS, 2))),
    "image": looks(("background: url(data:image/png;base64,{})",), lambda r: "iVBORw0KGgo" + some(r, 90, LETTERS + DIGITS + "+/")),
    "date and version": looks(("release {}", "build {}"), lambda r: f"2024-{some(r, 2, DIGITS)}-{some(r, 2, DIGITS)}T{some(r, 2, DIGITS)}-{some(r, 2, DIGITS)}_v1_{some(r, 2, DIGITS)}"),
    "public key": looks(("{}",), lambda r: "-----BEGIN CERTIFICATE-----"),
}


def draw(shapes, each, seed):
    rng = random.Random(seed)
    return [(name, *shape(rng)) for name, shape in shapes.items() for _ in range(each)]


def verdict(rows, findings):
    """Recall of each secret shape, share of each plain shape that is wrongly marked, and the precision over all.

    `findings` has, for each row, the marked stretches (start, length); a secret counts as found if they
    cover 90 % of its value, and a marked stretch as wrong if it holds none of a value.
    """
    found, right, wrong = {}, 0, 0
    for (name, text, value), marks in zip(rows, findings):
        at = text.index(value) if value else 0
        inside = lambda s, n: max(0, min(s + n, at + len(value)) - max(s, at)) if value else 0
        hit = sum(inside(s, n) for s, n in marks) >= 0.9 * len(value) if value else bool(marks)
        found.setdefault(name, []).append(hit)
        right += sum(inside(s, n) > 0 for s, n in marks)
        wrong += sum(inside(s, n) == 0 for s, n in marks)
    return {k: sum(v) / len(v) for k, v in found.items()}, right / max(1, right + wrong)


#: Shapes that were written down and measured before the trainer knew them; it has been widened since.
LATER_SECRETS = {
    "twilio": given(("TWILIO_AUTH_TOKEN={}", "twilio {}"), lambda r: "SK" + some(r, 32, HEX)),
    "mailgun": whole(lambda r: "key-" + some(r, 32, HEX)),
    "uuid key": given(("HEROKU_API_KEY={}", "api_key: {}"), lambda r: "-".join(some(r, k, HEX) for k in (8, 4, 4, 4, 12))),
    "npmrc": given(("//registry.example/:_authToken={}",), lambda r: some(r, 36)),
    "basic auth": given(("Authorization: Basic {}", "curl -H 'Authorization: Basic {}'"), lambda r: base64.b64encode(f"{r.choice(NOUNS)}:{password(r, 12)}".encode()).decode()),
    "docker auth": given(('"auth": "{}"',), lambda r: base64.b64encode(f"{r.choice(NOUNS)}:{password(r, 14)}".encode()).decode()),
    "oauth client": given(("client_secret: {}", '"client_secret":"{}"'), lambda r: "GOCSPX-" + some(r, 28, URLSAFE)),
    "shell password": given(("PGPASSWORD='{}' psql", "mysql --password={}", "sshpass -p {} ssh host"), lambda r: password(r, 12)),
    "key base": given(("SECRET_KEY_BASE={}",), lambda r: some(r, 128, HEX)),
    "webhook": given(("https://hooks.chat.example/services/{}",), lambda r: f"T{some(r, 8, UPPER)}/B{some(r, 8, UPPER)}/{some(r, 24)}"),
    "signature": given(("https://x.blob.example/c?sv=2022&sig={}",), lambda r: some(r, 43, LETTERS + DIGITS) + "%3D"),
}
LATER_PLAIN = {
    "etag": looks(('ETag: "{}"', 'etag="{}"'), lambda r: some(r, 32, HEX)),
    "image digest": looks(("image@sha256:{}", "pulled sha256:{}"), lambda r: some(r, 64, HEX)),
    "trace": looks(("trace_id={}", "span {}"), lambda r: some(r, 32, HEX)),
    "photo": looks(("file {}", "src={}"), lambda r: f"IMG_2024{some(r, 4, DIGITS)}_{some(r, 6, DIGITS)}.jpg"),
    "pod": looks(("pod {}", "kubectl logs {}"), lambda r: f"{r.choice(NOUNS)}-{some(r, 10, HEX)}-{some(r, 5, string.ascii_lowercase)}"),
    "resource name": looks(("{}",), lambda r: f"arn:aws:iam::{some(r, 12, DIGITS)}:role/{r.choice(NOUNS)}-{r.choice(NOUNS)}"),
    "style": looks(('class="{}"',), lambda r: "css-" + some(r, 10, string.ascii_lowercase + DIGITS)),
    "bucket": looks(("s3://{}",), lambda r: f"{r.choice(NOUNS)}-{r.choice(NOUNS)}-2024/part-{some(r, 5, DIGITS)}.parquet"),
    "question": looks(("how do I reset my password {}", "the token {} is unknown"), lambda r: r.choice(("please?", "when locked out", "parameter here", "expired yesterday"))),
}


#: Shapes that were written down last of all; nothing was changed after they were measured.
LAST_SECRETS = {
    "xml": given(("<password>{}</password>", "<add key='ApiKey' value='{}'/>"), lambda r: password(r, 12)),
    "ini": given(("db.password = {}", "smtp_pass: {}", "secret_token={}"), lambda r: some(r, 14)),
    "encoded yaml": given(("  password: {}", "  apiToken: {}"), lambda r: base64.b64encode(password(r, 14).encode()).decode()),
    "json token": given(('"accessToken":"{}"', '{{"refresh_token": "{}"}}'), lambda r: some(r, 40, URLSAFE)),
    "bot": given(("bot {}", "BOT_TOKEN={}"), lambda r: f"{some(r, 9, DIGITS)}:AA{some(r, 33, URLSAFE)}"),
    "cloud": whole(lambda r: "dop_v1_" + some(r, 64, HEX)),
    "project key": given(("{}", "OPENAI_KEY={}"), lambda r: "sk-proj-" + some(r, 48, URLSAFE)),
    "payment": given(("{}", "SQUARE_SECRET={}"), lambda r: "sq0csp-" + some(r, 43, URLSAFE)),
    "ftp": given(("ftp://deploy:{}@files.example/", "amqps://svc:{}@mq/%2f"), phrase),
    "cloud client": given(("AZURE_CLIENT_SECRET={}", "client_secret: {}"), lambda r: some(r, 3) + "8Q~" + some(r, 34, URLSAFE)),
    "header": given(("X-Auth-Token: {}", "api-key: {}"), lambda r: some(r, 32, HEX)),
}
LAST_PLAIN = {
    "describe": looks(("version {}", "tag {}"), lambda r: f"v1.{some(r, 1, DIGITS)}.{some(r, 1, DIGITS)}-{some(r, 2, DIGITS)}-g{some(r, 7, HEX)}"),
    "object id": looks(('"_id": "{}"', "id={}"), lambda r: some(r, 24, HEX)),
    "account number": looks(("IBAN {}", "pay to {}"), lambda r: "DE" + some(r, 20, DIGITS)),
    "hardware": looks(("mac {}", "ether {}"), lambda r: ":".join(some(r, 2, HEX) for _ in range(6))),
    "bundle": looks(('src="/static/{}"', "loaded {}"), lambda r: f"main.{some(r, 20, HEX)}.js"),
    "module": looks(("from {} import x", "package {}"), lambda r: ".".join(r.sample(NOUNS, 3))),
    "constant": looks(("set {} to 5", "{}=true", "export {}=1"), lambda r: "_".join(r.sample(NOUNS, 3)).upper() + "_2"),
    "form": looks(('<input name="{}">', 'label="{}"'), lambda r: "_".join(r.sample(NOUNS, 2)) + "_field"),
    "setting": looks(("password_min_length: {}", "token_expiry={}"), lambda r: r.choice(("12", "3600", "30 days"))),
    "advice": looks(("never share your password: {}", "store the api_key = {}"), lambda r: r.choice(("anyone could read it", "somewhere safe", "outside the repository"))),
    "query": looks(("https://shop.example/?{}",), lambda r: f"q={r.choice(NOUNS)}&page={some(r, 2, DIGITS)}&session={some(r, 8, DIGITS)}"),
}


def public_block(rng):
    lines = "\n".join(some(rng, 64, LETTERS + DIGITS + "+/") for _ in range(rng.randint(3, 12)))
    kind = rng.choice(("PUBLIC KEY", "CERTIFICATE", "RSA PUBLIC KEY"))
    return f"-----BEGIN {kind}-----\n{lines}\n{some(rng, 22)}==\n-----END {kind}-----"


#: Shapes that a reader of the scan missed, or saw marked wrongly.
ASKED_SECRETS = {
    "mail pass": given(("smtp_pass: {}", "MAIL_PASS={}", "imap.pass = {}"), password),
    "element": given(("<password>{}</password>", "<db-password>{}</db-password>", "<apiKey>{}</apiKey>"), lambda r: password(r, 12)),
    "yaml pass": given(("  pass: {}", "pass: {}"), lambda r: r.choice((password, phrase))(r)),
    "said": given(("the passphrase is {}", "my password is {}", "the wifi password is: {}"), lambda r: r.choice((password, phrase))(r)),
}
ASKED_PLAIN = {
    "inline image": looks(('<img src="data:image/png;base64,{}">', "<img src='data:image/jpeg;base64,{}' alt='x'>"), lambda r: "iVBORw0KGgo" + some(r, 200, LETTERS + DIGITS + "+/")),
    "ssh key": looks(("ssh-rsa {} me@host",), lambda r: "AAAAB3NzaC1yc2EAAAADAQABAAABgQ" + some(r, 340, LETTERS + DIGITS + "+/")),
    "short ssh key": looks(("ssh-ed25519 {} me@host", "ssh-ed25519 {}"), lambda r: "AAAAC3NzaC1lZDI1NTE5AAAAI" + some(r, 43, LETTERS + DIGITS + "+/")),
    "public block": looks(("{}",), public_block),
    "said plainly": looks(("the password is {}", "its token is {}"), lambda r: r.choice(("mandatory", "required here", "something else", "forgotten again", "whatever you like"))),
    "other pass": looks(("passenger: {}", "compass={}", "boarding pass: {}"), lambda r: "_".join(r.sample(NOUNS, 2))),
}
