"""F8: infrastructure-as-code scan → candidate rules.

Row-local like the text scanners: per detector one ``regexp_extract_all``
column, filters and "first by position" de-duplication on the row's array,
numbering per detector, then "first detector wins" across the pipeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.text import jrx, regex_escape

# Allow- and block-lists of the IaC detectors.
CIDR_ALLOWLIST = ["0.0.0.0/0", "::/0"]
DB_USER_BLOCKLIST = ["admin", "root", "postgres", "mysql", "oracle", "sa", "user", "dbuser", "dbadmin", "administrator"]
PUBLIC_AWS_ACCOUNT_BLOCKLIST = ["099720109477", "137112412989", "309956199498", "125523088429", "013907871322",
                                "679593333241"]
GENERIC_NAME_TOKENS = [
    "web", "app", "db", "api", "lb", "sg", "rt", "igw", "nat", "vpc",
    "public", "private", "internal", "external", "server", "worker",
    "frontend", "backend", "proxy", "cache", "queue", "bus", "data",
    "subnet", "group", "cluster", "node", "pod", "svc", "service",
    "gateway", "listener", "target", "route", "table", "association",
    "instance", "launch", "template", "asg", "tg", "alb", "nlb", "elb",
    "name", "key", "tag", "id", "env",
]
RESOURCE_NAME_VALUE_BLOCKLIST = ["HTTP", "HTTPS", "TCP", "UDP", "application", "network", "gateway", "instance",
                                 "postgres", "mysql", "aurora", "mariadb"]

# Detectors (key, JavaScript source, flags, replacement prefix, description prefix).
IAC_DETECTORS = {
    "cidr": (r"\b(\d{1,3}(?:\.\d{1,3}){3}\/\d{1,2})\b", "", "CIDR_BLOCK", "CIDR block: "),
    "account": (r"[\"'](\d{12})[\"']", "", "AWS_ACCOUNT", "AWS account / owner ID: "),
    "file_path": (r"(?:file\([\"']|[\"'])((?:~\/|\/)[^\s\"')]+\.(?:pub|pem|key|crt|cer|pfx|p12|jks))\b", "",
                  "FILE_PATH", "Sensitive file path: "),
    "db_user": (r"\busername\s*=\s*[\"']([^\"'\s${]+)[\"']", "i", "DB_USER", "Hardcoded DB username: "),
    "db_password": (r"\bpassword\s*=\s*[\"']([^\"'\s${]{4,})[\"']", "i", "DB_PASSWORD", "Hardcoded DB password: "),
    "resource": (r"(?:^|\s)(?:Name|name|identifier|key_name)\s*=\s*[\"']([^\"'${}\s]+)[\"']", "m", "RESOURCE_NAME",
                 "Infrastructure resource name: "),
    "region": (r"[\"']((?:us|eu|ap|sa|ca|me|af|il)-(?:east|west|north|south|central|northeast|southeast|southwest|northwest)-\d)[\"']",
               "", "REGION", "Cloud region: "),
    "secret": (r"(?:api_key|secret_key|access_key|auth_token|client_secret|webhook_secret)\s*=\s*[\"']([^\"'\s${]{16,})[\"']",
               "i", "SECRET", "Inline secret / API key"),
    "bucket": (r"\bbucket\s*=\s*[\"']([^\"'${}\s]+)[\"']", "", "BUCKET_NAME", "Storage bucket name: "),
    "ami": (r"\b(ami-[0-9a-f]{8,17})\b", "", "AMI_ID", "AMI identifier: "),
    "ami_filter": (r"[\"']([a-z][a-z0-9_\-/.*]+(?:server|hvm|ssd|ebs|gp2|arm64|amd64)[a-z0-9_\-/.*]*)[\"']", "i",
                   "AMI_FILTER", "AMI name filter pattern: "),
    "arn": (r"\b(arn:aws[a-zA-Z-]*:[a-zA-Z0-9-]+:[a-z0-9-]*:\d{12}:[^\s\"',]+)", "", "ARN", "AWS ARN: "),
    "ip": (r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b(?!\/\d)", "", "IP", "IP address: "),
}
# Literal substrings one of which every match of a detector contains (lower-cased
# when the detector ignores case): a cheap gate before the regex runs.
IAC_GATES = {
    "cidr": ["/"], "file_path": [".pub", ".pem", ".key", ".crt", ".cer", ".pfx", ".p12", ".jks"], "db_user": ["username"],
    "db_password": ["password"], "resource": ["ame", "identifier"], "region": ["east-", "west-", "north-", "south-", "central-"],
    "secret": ["api_key", "secret_key", "access_key", "auth_token", "client_secret", "webhook_secret"], "bucket": ["bucket"],
    "ami": ["ami-"], "arn": ["arn:aws"], "ami_filter": ["server", "hvm", "ssd", "ebs", "gp2", "arm64", "amd64"],
}
# Pipeline orders (db = usernames then passwords).
TERRAFORM_ORDER = ["cidr", "region", "account", "arn", "ami", "ami_filter", "file_path", "db_user", "db_password",
                   "secret", "bucket", "resource", "ip"]
GENERIC_ORDER = ["cidr", "ip", "file_path", "db_user", "db_password", "secret", "account", "arn", "ami"]

_STR_ARRAY = T.ArrayType(T.StringType())


def _keep(name: str):
    """Per-detector value filter (before the detector's own first-by-position dedupe)."""
    if name == "cidr":
        return lambda v: ~v.isin(*CIDR_ALLOWLIST)
    if name == "account":
        return lambda v: ~v.isin(*PUBLIC_AWS_ACCOUNT_BLOCKLIST)
    if name == "db_user":
        return lambda v: ~F.lower(v).isin(*DB_USER_BLOCKLIST)
    if name == "resource":
        def keep(v):
            toks = F.filter(F.split(F.lower(v), r"[-_\s]+", -1), lambda t: t != "")
            generic = (F.size(toks) > 0) & F.forall(toks, lambda t: t.isin(*GENERIC_NAME_TOKENS))
            return (F.length(v) >= 5) & ~v.isin(*RESOURCE_NAME_VALUE_BLOCKLIST) & ~v.contains("${") & ~generic
        return keep
    if name == "ami_filter":
        return lambda v: v.contains("/")
    if name == "ip":
        return lambda v: ~v.isin("0.0.0.0", "255.255.255.255") & ~v.startswith("127.") & ~v.startswith("169.254.")
    return lambda v: F.lit(True)


def _first_positions(df: DataFrame, col: str) -> DataFrame:
    """Keep the first occurrence of each value of an array column, order kept."""
    return df.withColumn(
        col,
        F.transform(
            F.filter(
                F.zip_with(F.col(col), F.sequence(F.lit(1), F.greatest(F.size(col), F.lit(1))),
                           lambda v, j: F.struct(v.alias("v"), j.alias("j"))),
                lambda y: y["v"].isNotNull() & (F.array_position(F.col(col), y["v"]) == y["j"]),
            ),
            lambda y: y["v"],
        ),
    )


def with_iac_detections(df: DataFrame, content_col: str, order: list[str], source: str,
                        out: str = "iac_rules") -> DataFrame:
    """array<struct<pattern, replacement, description, source, value, det, n>> per row."""
    text = F.coalesce(F.col(content_col), F.lit(""))
    lower_c = f"_iac_lower_{out}"
    df = df.withColumn(lower_c, F.lower(text))
    tmp = [lower_c]
    for name in order:
        src, flags, _rep, _desc = IAC_DETECTORS[name]
        c = f"_iac_{name}_{out}"
        found = F.filter(F.regexp_extract_all(text, F.lit(jrx(src, flags)), 1), _keep(name))
        if name in IAC_GATES:
            gate = F.lit(False)
            for lit in IAC_GATES[name]:
                gate = gate | (F.col(lower_c) if "i" in flags else text).contains(lit)
            found = F.when(gate, found).otherwise(F.array().cast(_STR_ARRAY))
        df = df.withColumn(c, found)
        df = _first_positions(df, c)
        tmp.append(c)
    if "db_user" in order and "db_password" in order:
        # usernames and passwords share one seen-set
        u, p = f"_iac_db_user_{out}", f"_iac_db_password_{out}"
        df = df.withColumn(p, F.filter(F.col(p), lambda v: ~F.array_contains(F.col(u), v)))
    parts = []
    for det, name in enumerate(order):
        _src, _flags, rep, desc = IAC_DETECTORS[name]
        c = f"_iac_{name}_{out}"
        show_value = name != "secret"
        parts.append(
            F.zip_with(
                F.col(c), F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))),
                _rule_struct(det, rep, desc, show_value, source),
            )
        )
    allc = f"_iac_all_{out}"
    df = df.withColumn(allc, F.filter(F.concat(*parts), lambda r: r["value"].isNotNull()))
    pats = f"_iac_pats_{out}"
    df = df.withColumn(pats, F.transform(allc, lambda r: r["pattern"]))
    df = df.withColumn(
        out,
        F.transform(
            F.filter(
                F.zip_with(F.col(allc), F.sequence(F.lit(1), F.greatest(F.size(allc), F.lit(1))),
                           lambda r, j: F.struct(r.alias("r"), j.alias("j"))),
                lambda y: y["r"].isNotNull() & (F.array_position(F.col(pats), y["r"]["pattern"]) == y["j"]),
            ),
            lambda y: y["r"],
        ),
    )
    return df.drop(*tmp, allc, pats)


def _rule_struct(det: int, rep: str, desc: str, show_value: bool, source: str):
    def f(v, j):
        return F.struct(
            regex_escape(v).alias("pattern"),
            F.concat(F.lit(rep + "_"), j.cast("string")).alias("replacement"),
            (F.concat(F.lit(desc), v) if show_value else F.lit(desc)).alias("description"),
            F.lit(source).alias("source"),
            v.alias("value"),
            F.lit(det).alias("det"),
            j.cast("int").alias("n"),
        )

    return f


def scan_iac(df: DataFrame, key_cols: list[str], name_col: str, content_col: str) -> DataFrame:
    """One row per candidate rule: ``.tf``/``.tfvars`` files run the terraform
    pipeline, all others the generic one; ids are hashes of (keys, pattern)."""
    is_tf = F.lower(F.regexp_extract(F.col(name_col), r"(\.[^./\\]*)$", 1)).isin(".tf", ".tfvars")
    tf = with_iac_detections(df.filter(is_tf), content_col, TERRAFORM_ORDER, "terraform", "_r")
    gen = with_iac_detections(df.filter(~is_tf | F.col(name_col).isNull()), content_col, GENERIC_ORDER, "generic", "_r")
    # the source is a literal of each side, so that a filter on it leaves out the other pipeline
    both = tf.withColumn("_source", F.lit("terraform")).unionByName(gen.withColumn("_source", F.lit("generic")))
    ex = both.select(*key_cols, "_source", F.posexplode_outer("_r").alias("rule_no", "r")).filter(F.col("r").isNotNull())
    return ex.select(
        *key_cols,
        F.concat(F.lit("rule_"), F.substring(F.sha2(F.concat_ws("\u0000", *[F.col(c).cast("string") for c in key_cols],
                                                                 F.col("r.pattern")), 256), 1, 16)).alias("id"),
        "r.pattern", "r.replacement", "r.description", F.col("_source").alias("source"), "rule_no",
    )


def file_kind(name: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1)).isin(".tf", ".tfvars"), F.lit("terraform")) \
        .otherwise(F.lit("generic"))
