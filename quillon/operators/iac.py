"""Structural findings in configuration files: pairs and lines of a whole file, tested by a table of kinds.

Column is always 1, the line is the first that holds the key, and the findings
ignore rule selection, allowlists and allow comments.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decode
from ..functions.text import basename
from ..schema import FINDING_COLUMNS, rank

#: Rows that a parser's task holds before it passes them on.
ROWS = 2_000
# Words that make a key sensitive, and kinds of files with what they report.
SENSITIVE = ("secret", "password", "passwd", "pwd", "token", "api_key", "apikey", "access_key", "accesskey", "private_key", "privatekey", "credential", "auth", "bearer", "client_secret", "clientsecret")
KINDS: dict[str, tuple[str, str, str, str]] = {  # kind: (extractor, rule, severity, description)
    "env": ("env", "iac-env-file-secret", "high", "Secret in .env file"),
    "aws-credentials": ("ini", "iac-aws-credentials-file", "critical", "AWS credential in credentials file"),
    "docker-compose": ("yaml", "iac-docker-compose-secret", "high", "Secret in docker-compose"),
    "kubernetes": ("yaml", "iac-k8s-pod-env-secret", "high", "Secret in K8s pod env"),
    "terraform": ("hcl", "iac-terraform-variable-secret", "high", "Secret in Terraform variable"),
    "ansible": ("lines", "iac-ansible-unencrypted-secret", "high", "Unencrypted Ansible secret"),
    "chef": ("json-top", "iac-chef-data-bag-secret", "high", "Secret in Chef data bag"),
    "puppet": ("yaml", "iac-puppet-hiera-secret", "high", "Secret in Puppet Hiera"),
    "cloudformation": ("json-yaml", "iac-cfn-secret", "high", "Secret in CloudFormation"),
    "pulumi": ("yaml", "iac-pulumi-config-secret", "high", "Secret in Pulumi config"),
    "serverless": ("yaml", "iac-serverless-secret", "high", "Secret in serverless.yml"),
    "cdk": ("lines", "iac-cdk-secret", "high", "Secret in AWS CDK code"),
    "terraform-cloud": ("json-yaml", "iac-tfc-secret", "high", "Secret in Terraform Cloud"),
    "github-actions": ("yaml", "iac-github-actions-secret", "high", "Secret in GitHub Actions env"),
    "gitlab-ci": ("yaml", "iac-gitlab-ci-secret", "high", "Secret in GitLab CI"),
    "circleci": ("yaml", "iac-circleci-secret", "high", "Secret in CircleCI config"),
    "jenkins": ("lines", "iac-jenkins-credential", "high", "Hardcoded credential in Jenkinsfile"),
    "drone": ("yaml", "iac-droneci-secret", "high", "Secret in DroneCI config"),
    "argocd": ("json-yaml", "iac-argocd-secret", "high", "Secret in ArgoCD ApplicationSet"),
    "helm": ("yaml", "iac-helm-values-secret", "high", "Secret in Helm values"),
    "kustomize": ("json-yaml", "iac-kustomize-secret", "high", "Secret in Kustomize"),
    "skaffold": ("yaml", "iac-skaffold-secret", "medium", "Secret in Skaffold config"),
    "tilt": ("lines", "iac-tilt-secret", "medium", "Secret in Tiltfile"),
    "garden": ("yaml", "iac-garden-secret", "medium", "Secret in Garden config"),
    "devspace": ("yaml", "iac-devspace-secret", "medium", "Secret in DevSpace config"),
    "okteto": ("yaml", "iac-okteto-secret", "medium", "Secret in Okteto manifest"),
    "acorn": ("lines", "iac-acorn-secret", "medium", "Secret in Acornfile"),
    "cosign": ("yaml", "iac-cosign-signing-key", "high", "Cosign signing key"),
}


def _named_yaml(name: Column) -> Column:
    return name.rlike(r"\.ya?ml$")


def file_kind(path: Column, name: Column | None = None, is_yaml: Column | None = None) -> Column:
    """The first kind whose name or folder test holds; name and is_yaml: the path's, where they are at hand."""
    n, p = basename(path) if name is None else name, path
    yaml = _named_yaml(n) if is_yaml is None else is_yaml
    tests: list[tuple[str, Column]] = [
        ("env", (n == ".env") | n.startswith(".env.")),
        ("aws-credentials", (n == "credentials") & p.contains(".aws")),
        ("docker-compose", n.startswith("docker-compose") & yaml),
        ("kubernetes", yaml & (n.rlike("deployment|pod|k8s|manifest") | p.rlike("k8s/|kubernetes/"))),
        ("terraform", n.rlike(r"\.(tf|tfvars)$")),
        ("ansible", p.contains("ansible") | n.contains("vault")),
        ("chef", p.rlike("data_bag|databag")),
        ("puppet", p.contains("hiera")),
        ("cloudformation", n.rlike("cloudformation|cfn") | n.rlike(r"^template.*\.(json|yaml)$")),
        ("pulumi", n.startswith("Pulumi.") & yaml),
        ("serverless", n.rlike(r"^serverless\.ya?ml$")),
        ("cdk", n.rlike(r"\.(ts|py)$") & p.rlike("cdk|stack")),
        ("terraform-cloud", n.rlike("terraform-cloud|tfc")),
        ("github-actions", p.contains(".github/workflows/") & yaml),
        ("gitlab-ci", n.rlike(r"^\.gitlab-ci\.ya?ml$")),
        ("circleci", p.contains(".circleci/") & (n == "config.yml")),
        ("jenkins", n == "Jenkinsfile"),
        ("drone", n.rlike(r"^\.drone\.ya?ml$")),
        ("argocd", n.rlike("argocd|applicationset")),
        ("helm", (n.startswith("values-") | (n == "values.yaml")) & yaml),
        ("kustomize", n.contains("kustomize") | n.rlike(r"^kustomization\.ya?ml$")),
        ("skaffold", n.rlike(r"^skaffold\.ya?ml$")),
        ("tilt", n == "Tiltfile"),
        ("garden", n.rlike(r"^garden\.ya?ml$")),
        ("devspace", n.rlike(r"^devspace\.ya?ml$")),
        ("okteto", n.rlike(r"^okteto\.ya?ml$")),
        ("acorn", n == "Acornfile"),
        ("cosign", n.contains("cosign")),
    ]
    out = F
    for kind, test in tests:
        out = out.when(test, kind)
    return out.otherwise(F.lit("unknown"))


def is_sensitive(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SENSITIVE))


def is_placeholder(value: Column) -> Column:
    low = F.lower(value)
    return (low == "") | (low == "example") | low.rlike(r"^(example-|your-|xxx)") | low.rlike(r"changeme|placeholder|<|\$\{|\{\{")


def clean(value: Column) -> Column:
    """Without outer quotes and a trailing comment."""
    bare = F.btrim(F.btrim(F.trim(value), F.lit('"')), F.lit("'"))
    return F.when(F.instr(bare, "#") > 0, F.trim(F.substring_index(bare, "#", 1))).otherwise(bare)


def _after(text: Column, separators: str) -> Column:
    """What follows the first of the separators; null if there is none."""
    return F.when(text.rlike(f"[{separators}]"), F.regexp_extract(text, rf"(?s)^[^{separators}]*[{separators}](.*)$", 1))


def _findings(rows: DataFrame) -> DataFrame:
    """rows: path, line, matched, context, rule_id, severity, description."""
    ranks = F.create_map(*[x for s in ("low", "medium", "high", "critical") for x in (F.lit(s), F.lit(rank(s)))])
    out = rows.withColumn("severity_rank", ranks[F.col("severity")]).withColumn("column", F.lit(1)).withColumn("likely_false_positive", F.lit(False))
    for c in ("commit", "verification", "verification_error"):
        out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*FINDING_COLUMNS)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a generator's output is not merged into what reads it."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_made")
    return df.select("*", made).select(*df.columns, *(F.col("_made")[n].alias(n) for n in columns))


def _kinds(*extractors: str) -> list[str]:
    return [k for k, (e, *_) in KINDS.items() if e in extractors]


def key_pairs(lines: DataFrame) -> DataFrame:
    """One critical finding a file that holds both an access key id and a secret key; the last of each counts."""
    low = F.lower("text")
    value = clean(_after(F.col("text"), "=:"))
    rows = lines.withColumn("value", value)
    is_id = low.rlike("aws[_-]access[_-]key[_-]id") & F.col("value").rlike("^(AKIA|ASIA)")
    is_secret = low.rlike("aws[_-]secret[_-]access[_-]key") & ~is_placeholder(F.col("value")) & (F.octet_length("value") >= 20)
    last = lambda test: F.max_by(F.struct("line", "value"), F.when(test, F.col("line")))
    both = rows.groupBy("path").agg(last(is_id).alias("i"), last(is_secret).alias("s"), F.count_if(is_id).alias("ni"), F.count_if(is_secret).alias("ns")).where("ni > 0 and ns > 0")
    return _findings(
        both.select(
            "path", F.col("i.line").alias("line"), F.concat_ws(" + ", "i.value", "s.value").alias("matched"),
            F.format_string("Pair at lines %d and %d", "i.line", "s.line").alias("context"), F.lit("iac-aws-key-pair").alias("rule_id"), F.lit("critical").alias("severity"),
            F.lit("AWS Access Key ID + Secret Access Key pair detected in same file").alias("description"),
        )
    )


def credential_chains(lines: DataFrame) -> DataFrame:
    """One critical finding a file with client id, client secret and tenant id."""
    low = F.lower("text")
    real = ~is_placeholder(clean(_after(F.col("text"), "=:")))
    has = lambda word: low.rlike(word) & real
    ident, secret, tenant = has("client_?id"), has("client_?secret"), has("tenant_?id")
    chain = lines.groupBy("path").agg(F.max(F.when(ident | secret, F.col("line"))).alias("line"), F.count_if(ident).alias("a"), F.count_if(secret).alias("b"), F.count_if(tenant).alias("c"))
    return _findings(
        chain.where("a > 0 and b > 0 and c > 0").select(
            "path", "line", F.lit("credential chain").alias("matched"), F.lit("All three OAuth chain components found in same file").alias("context"),
            F.lit("iac-oauth-credential-chain").alias("rule_id"), F.lit("critical").alias("severity"), F.lit("OAuth credential chain detected: client_id + client_secret + tenant_id").alias("description"),
        )
    )


def _placeholder(value: str) -> bool:
    """is_placeholder of a string."""
    low = value.lower()
    return low in ("", "example") or low.startswith(("example-", "your-", "xxx")) or any(x in low for x in ("changeme", "placeholder", "<", "${", "{{"))


def _clean(value: str) -> str:
    """clean of a string."""
    bare = value.strip(" ").strip('"').strip("'")
    return bare.partition("#")[0].strip(" ") if "#" in bare else bare


def _sensitive(key: str) -> bool:
    low = key.lower()
    return any(word in low for word in SENSITIVE)


def _line_pairs(extractor: str, lines: list[str]) -> Iterator[tuple[str, str]]:
    """decode.yaml_pairs, env_pairs or ini_pairs of one file's lines."""
    section = ""
    for bare in (x.strip(" ") for x in lines):
        if bare.startswith("#"):
            continue
        if extractor == "yaml":
            key, found, value = bare.partition(":")
            if found and value.strip(" "):
                yield key.strip(" "), value.strip(" ")
        elif extractor == "env":
            key, found, value = bare.removeprefix("export ").partition("=")
            if found and key.strip(" "):
                yield key.strip(" "), value.strip(" ").strip("\"'")
        elif bare.startswith("[") and bare.endswith("]"):
            section = bare[1:-1]
        elif not bare.startswith(";"):
            key, found, value = (x.strip(" ") for x in bare.partition("="))
            if found:
                yield f"{section}.{key}" if section else key, value


def _walk(node, top: bool) -> Iterator[tuple[str, str]]:
    if isinstance(node, dict):
        for k, v in node.items():
            if isinstance(v, str):
                yield k, v
            if not top:
                yield from _walk(v, False)
    elif isinstance(node, list) and not top:
        for v in node:
            yield from _walk(v, False)


def _pair_wanted(kind: str, key: str, value: str) -> bool:
    if kind == "aws-credentials":
        return any(x in key.lower() for x in ("aws_access_key_id", "aws_secret_access_key", "aws_session_token"))
    if kind == "kubernetes":
        return ("env" in key or "ENV" in key) and _sensitive(value)
    if kind == "terraform":
        return "default" in key and _sensitive(key)
    if kind == "pulumi":
        return ("secure" in key or _sensitive(key)) and not value.startswith("true")
    if kind == "github-actions":
        return _sensitive(key) and "${{" not in value
    if kind == "cosign":
        return any(x in key.lower() for x in ("cosign", "signing", "key")) or _sensitive(key)
    return _sensitive(key)


# the dot and the end of java.util.regex
_HEAD, _TAIL = re.compile("([^\n\r\x85\u2028\u2029]*): "), re.compile("[^\n\r\x85\u2028\u2029]*: ([^\n\r\x85\u2028\u2029]*)(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z)")


def _in_line(kind: str, text: str) -> list[str]:
    """Values that a line of a kind gives by itself."""
    low, bare, value = text.lower(), text.strip(" "), None
    if kind == "ansible":
        key, found, rest = bare.partition(":")
        if found and not bare.startswith(("-", "#")) and _sensitive(key.strip(" ")):
            value = rest
    elif kind == "cdk":
        if "=" in text and any(x in low for x in ("cdk", "construct", "stack")) and _sensitive(text):
            value = text.partition("=")[2]
    elif kind in ("tilt", "acorn"):
        sep = "=" if kind == "tilt" else ":"
        if sep in text and any(x in low for x in ("secret", "password", "token")):
            value = text.partition(sep)[2]
    elif kind == "github-actions":
        if "secrets." in bare and "${{" not in bare and "=" in bare:
            value = bare.partition("=")[2]
    elif kind == "docker-compose":
        if bare.startswith("- ") and "=" in bare and _sensitive(bare[2:].partition("=")[0]):
            value = bare.partition("=")[2]
    elif kind == "pulumi":
        head = _HEAD.match(bare)
        if head and not bare.startswith("#") and _sensitive(head[1]):
            tail = _TAIL.match(bare)
            value = tail[1] if tail else ""
    elif kind == "jenkins" and any(x in low for x in ("credentials", "secret", "password")):
        return [m for m in re.findall("'([^']*)'", text) if len(m.encode()) >= 8 and not m.startswith("$") and not _placeholder(m)]
    if value is None:
        return []
    value = _clean(value)
    variable = value.startswith("$") if kind in ("tilt", "acorn") else kind == "pulumi" and value.startswith("true")
    return [] if variable or _placeholder(value) else [value]


def _of_file(kind: str, text: str, as_yaml: bool) -> Iterator[tuple]:
    """(line, matched, context, rule_id, severity, description) of one file's findings."""
    extractor, rule, severity, about = KINDS[kind]
    plain = text.replace("\r\n", "\n")
    lines = plain.removesuffix("\n").split("\n")
    if extractor == "hcl":
        pairs = decode.hcl_pairs(text)
    elif extractor in ("json-top", "json-yaml"):
        try:
            pairs = list(_walk(json.loads(text), extractor == "json-top"))
        except ValueError:
            pairs = []
    else:
        pairs = []
    # what is deep in JSON is reported at line 1; other keys at the first line that holds them, or else 1
    fixed = extractor == "json-yaml"
    rest = _line_pairs("yaml" if as_yaml else extractor, lines) if as_yaml or extractor in ("env", "ini") else ()
    sep = "=" if kind in ("env", "aws-credentials") else " = " if kind == "terraform" else ": "
    first: dict[str, int] = {}
    for one, own in ((fixed, pairs), (False, rest)):
        for key, value in own:
            if not _pair_wanted(kind, key, value) or _placeholder(value):
                continue
            if not one and key not in first:
                first[key] = 1 if "\n" in key else plain.count("\n", 0, max(0, plain.find(key))) + 1
            yield 1 if one else first[key], value, f"{key}{sep}{value}", rule, severity, f"{about}: {key}"
    if kind in _BY_LINE and "$ANSIBLE_VAULT;" not in text:
        for n, line in enumerate(lines, 1):
            for value in _in_line(kind, line):
                yield n, value, line.strip(" "), rule, severity, about
    if kind == "cosign" and re.search("-----BEGIN (EC )?PRIVATE KEY-----", text):
        at = plain.count("\n", 0, plain.find("-----BEGIN")) + 1
        yield at, "-----BEGIN PRIVATE KEY-----", "private key", "iac-cosign-private-key", "critical", "Cosign private key in file"


#: Kinds whose lines give findings by themselves.
_BY_LINE = ("ansible", "cdk", "tilt", "acorn", "github-actions", "docker-compose", "pulumi", "jenkins")


def scan_files(documents: DataFrame) -> DataFrame:
    """All structural findings of documents (path, text).

    Every document is judged by itself, in one pass: a finding needs the lines
    before it (a section, the first line that holds a key), and these are at
    hand where a file is whole. Pairs and chains of a file's lines are sought
    in the documents that hold a part of one.
    """
    from .scan import lines_of

    # a file's kind is a function of its path, so other files are left out before their texts are read
    docs = _once(documents.select("path", "text"), name=basename("path"))
    docs = _once(docs, is_yaml=_named_yaml(F.col("name")))
    docs = _once(docs, kind=file_kind(F.col("path"), F.col("name"), F.col("is_yaml"))).where("kind <> 'unknown' and text <> ''")
    as_yaml = F.col("kind").isin(_kinds("yaml")) | (F.col("kind").isin(_kinds("json-yaml")) & F.try_parse_json("text").isNull())
    columns = ["path", "line", "matched", "context", "rule_id", "severity", "description"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, kind, text, yaml in zip(pdf["path"], pdf["kind"], pdf["text"], pdf["as_yaml"], strict=True):
                for hit in _of_file(kind, text, yaml):
                    rows.append((path, *hit))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    found = docs.select("path", "kind", "text", as_yaml.alias("as_yaml")).mapInPandas(run, "path string, line int, matched string, context string, rule_id string, severity string, description string")
    # a document without any of the words has no part in a pair or a chain
    some = lambda words: lines_of(documents.where(F.lower("text").rlike(words)))
    return _findings(found).unionByName(key_pairs(some("aws[_-](access[_-]key[_-]id|secret[_-]access[_-]key)"))).unionByName(credential_chains(some("client_?id|client_?secret|tenant_?id")))
