"""Pattern data of languages, in the registry's token language (see functions.text.token_regex)."""

from __future__ import annotations

#: Tokens by language and field.
TOKENS = {
    "python": {
        "test_names": ("test_?*.py", "?*_test.py"),
        "colocated_names": (),
        "test_declarations": ("def test* (", "async def test* ("),
        "assertions": ("assert", "assert<A-Z>*", "assert_?*"),
        "skips": ("@pytest.mark.skip", "pytest.skip (", "@unittest.skip", "self.skipTest ("),
        "network_calls": ("urllib.request.urlopen (", "urlopen (", "socket.create_connection (", "requests.get (", "requests.post (", "requests.put (", "requests.patch (", "requests.delete (", "requests.head (", "requests.request (", "httpx.get (", "httpx.post (", "httpx.request ("),
        "type_escapes": ("type : ignore", ": Any", "-> Any", "typing.Any"),
        "cookie_calls": (".set_cookie (",),
        "cookie_secure": ("secure = True",),
        "cookie_httponly": ("httponly = True",),
        "cookie_samesite": ("samesite =",),
        "outbound_calls": ("requests.get (", "requests.post (", "requests.put (", "requests.patch (", "requests.delete (", "requests.head (", "requests.options (", "requests.request (", "urlopen (", "urllib.request.urlopen ("),
        "call_timeouts": ("timeout =",),
        "query_calls": (".execute (", ".objects.get (", ".objects.filter (", "session.query (", ".session.query ("),
        "loops": ("for", "while"),
    },
    "js-ts": {
        "test_names": ("?*.test.js", "?*.spec.js", "?*.test.jsx", "?*.spec.jsx", "?*.test.ts", "?*.spec.ts", "?*.test.tsx", "?*.spec.tsx"),
        "colocated_names": ("?*.test.js", "?*.spec.js", "?*.test.jsx", "?*.spec.jsx", "?*.test.ts", "?*.spec.ts", "?*.test.tsx", "?*.spec.tsx"),
        "test_declarations": ('it ( "', "it ( '", "it ( `", 'test ( "', "test ( '", "test ( `"),
        "assertions": ("expect (", ".should", "assert"),
        "skips": ("it.skip (", "test.skip (", "describe.skip (", "xit (", "xtest (", "xdescribe ("),
        "network_calls": ("fetch (", "http.request (", "http.get (", "https.request (", "https.get (", "axios (", "axios.get (", "axios.post ("),
        "type_escapes": (": any", "as any", "@ts-ignore", "@ts-nocheck"),
        "cookie_calls": (".cookie (", "session (", "cookieSession (", "express.session ("),
        "cookie_secure": ("secure : true",),
        "cookie_httponly": ("httpOnly : true",),
        "cookie_samesite": ("sameSite :",),
        "outbound_calls": ("fetch (", "axios (", "axios.get (", "axios.post (", "axios.put (", "axios.patch (", "axios.delete (", "axios.head (", "axios.request (", "http.request (", "https.request (", "https.get ("),
        "call_timeouts": ("timeout", "signal"),
        "query_calls": (".findUnique (", ".findFirst (", ".findMany (", ".findOne (", ".findById (", ".findByPk (", ".findAll ("),
        "loops": ("for", "while", "do", ".forEach (", ".map (", ".flatMap ("),
    },
}
#: Sinks as (weakness, token) by language.
SINKS = {
    "python": (("CWE-95", "eval ("), ("CWE-95", "exec ("), ("CWE-78", "os.system ("), ("CWE-78", "os.popen (")),
    "js-ts": (("CWE-95", "eval ("), ("CWE-95", "new Function ("), ("CWE-78", "child_process.exec (")),
}
#: Directory names that say what a file below them is.
TEST_DIRS = ("test", "tests", "spec", "specs", "__tests__")
SOURCE_DIRS = ("src", "lib", "app")
NOT_UNIT_DIRS = ("integration", "e2e", "functional")
#: Layers by path, the first that fits.
LAYERS = (
    ("api", ("**/controllers/**", "**/*.controller.*", "**/*Controller.*", "**/routes/**", "**/*.routes.*", "**/handlers/**", "**/api/**", "**/views.py", "**/views/**", "**/urls.py", "**/middlewares/**")),
    ("service", ("**/services/**", "**/service/**", "**/*.service.*", "**/*Service.*", "**/usecases/**", "**/use_cases/**")),
    ("data", ("**/repositories/**", "**/repository/**", "**/*.repository.*", "**/*Repository.*", "**/dao/**", "**/models/**", "**/models.py", "**/entities/**", "**/migrations/**")),
    ("shared", ("**/dto/**", "**/*.dto.*", "**/utils/**", "**/constants/**", "**/types/**", "**/*.d.ts", "**/*.config.*")),
)
LAYER_RANK = {"data": 0, "service": 1, "api": 2}
#: Destructive statements of schema migrations.
DESTRUCTIVE_DDL = ("drop table", "drop column", "drop schema", "drop database", "rename column", "rename to")
DESTRUCTIVE_API = r"\b(?:drop|remove|delete|rename)_?(?:table|column|field|model)s?(?:_?if_?exists)?\b|\bdrop_?if_?exists\b"
#: Words of money names, words that rule one out, ledgers, heads and endings of names.
MONEY = ("amount", "amounts", "price", "prices", "balance", "balances", "fee", "fees", "cost", "costs", "subtotal", "salary", "salaries", "revenue", "refund", "refunds", "payout", "payouts")
NOT_MONEY = ("count", "counts", "qty", "quantity", "quantities", "item", "items", "page", "pages", "number", "num", "cents", "cent", "pence", "micros", "minor", "satoshi", "satoshis", "percent", "percentage", "pct", "bps", "rate", "rates", "ratio", "factor", "weight", "id", "ids", "index", "idx", "type", "kind", "currency", "code", "format", "precision", "scale", "digits", "decimals")
LEDGERS = ("ledger", "journal", "transaction", "payment", "transfer", "posting")
NOT_LEDGER_HEADS = ("method", "methods", "type", "types", "status", "statuses", "state", "kind", "provider", "gateway", "config", "configuration", "setting", "settings", "option", "options", "category", "categories", "template", "id")
NAME_ENDINGS = ("repository", "repo", "dao", "model", "entity", "table", "collection", "schema")
#: Kinds of change by the prefix of a branch or a commit subject, in order of strength.
CHANGE_KINDS = ("bugfix", "feature", "refactor", "chore")
PREFIXES = {"fix": "bugfix", "bugfix": "bugfix", "hotfix": "bugfix", "feat": "feature", "feature": "feature", "refactor": "refactor", "chore": "chore", "docs": "chore", "build": "chore", "ci": "chore", "style": "chore"}
