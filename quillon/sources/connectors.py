"""Remote sources as Python data sources.

A connector is a chain of steps. A step lists items page by page from an
address; each item goes into the next step's address, as a repository's files
go into the address of a blob; the last step's items hold the texts. One
DataSource serves all connectors. Every partition is one container (repository,
project, channel ...), so containers are fetched in parallel.

    spark.dataSource.register(ConnectorSource)
    spark.read.format("quillon").option("connector", "jira").option("containers", "acme.example.org").load()

Options: `containers`, `token`, `max_items`, `endpoint` (another scheme and host
for every address), `fixture` (a JSON file {container: [page of the last step,
...]} in place of the network).
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
import shlex
import subprocess
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages of one list at most, against services that never say they are done.
MOST_PAGES = 10_000


@dataclass(frozen=True)
class Step:
    """One list: address with {container} and {k.path} of step k's item, path of its items, way to the next page, form of an answer.

    paging is empty (one page), `link` (Link header), `next PATH` (the next address in the
    answer), `token PATH PARAMETER` (a cursor), `page PARAMETER` (numbers from 1 until a page is
    empty) or `offset PARAMETER` (items seen so far, until a page is empty). form is json, xml, text
    (the whole answer is one item) or command (the address is run, and its output is JSON).
    """

    url: str
    items: str = ""
    paging: str = ""
    form: str = "json"


@dataclass(frozen=True)
class Connector:
    """The steps to a service's items and which of their fields are text; auth is a header's value, or its name too."""

    name: str
    steps: tuple[Step, ...]
    key: str  # template over the items of all steps
    texts: tuple[str, ...]  # dotted paths in the last item
    encoding: str = "plain"  # or base64
    auth: str = "Authorization: Bearer {token}"


def _c(name: str, key: str, texts: str, *steps: Step, encoding: str = "plain", auth: str = "Authorization: Bearer {token}") -> Connector:
    return Connector(name, steps, key, tuple(texts.split()), encoding, auth)


# Public addresses and field names of the services.
CONNECTORS: dict[str, Connector] = {
    c.name: c
    for c in (
        _c("github", "{0.path}", "content", Step("https://api.github.com/repos/{container}/git/trees/HEAD?recursive=1", "tree[type=blob]"), Step("https://api.github.com/repos/{container}/git/blobs/{0.sha}"), encoding="base64"),
        _c("gitlab", "{0.path}", "content", Step("https://gitlab.com/api/v4/projects/{container|all}/repository/tree?recursive=true&per_page=100", "[type=blob]", "link"), Step("https://gitlab.com/api/v4/projects/{container|all}/repository/files/{0.path|all}?ref=HEAD"), encoding="base64", auth="PRIVATE-TOKEN: {token}"),
        _c("s3", "{0.Key}", "body", Step("https://{container}.s3.amazonaws.com/?list-type=2", "Contents", "token NextContinuationToken continuation-token", "xml"), Step("https://{container}.s3.amazonaws.com/{0.Key}", form="text"), auth="aws s3"),
        _c("gcs", "{0.name}", "body", Step("https://storage.googleapis.com/storage/v1/b/{container}/o", "items", "token nextPageToken pageToken"), Step("https://storage.googleapis.com/storage/v1/b/{container}/o/{0.name|all}?alt=media", form="text")),
        _c("azure_blob", "{0.Name}", "body", Step("https://{container}?restype=container&comp=list", "Blobs.Blob", "token NextMarker marker", "xml"), Step("https://{container}/{0.Name}", form="text")),
        _c("oss", "{0.Key}", "body", Step("https://{container}.aliyuncs.com/?list-type=2", "Contents", "token NextContinuationToken continuation-token", "xml"), Step("https://{container}.aliyuncs.com/{0.Key}", form="text")),
        _c("confluence", "{0.id}", "title body.storage.value", Step("https://{container}/wiki/api/v2/pages?body-format=storage&limit=100", "results", "next _links.next")),
        _c("slack", "{0.ts}", "text", Step("https://slack.com/api/conversations.history?channel={container}&limit=200", "messages", "token response_metadata.next_cursor cursor")),
        _c("jira", "{0.key}", "fields.summary fields.description fields.comment.comments", Step("https://{container}/rest/api/3/search?fields=summary,description,comment&maxResults=100", "issues", "offset startAt")),
        _c("postman", "{0.name}", "request event", Step("https://api.getpostman.com/collections/{container}", "collection.item"), auth="X-Api-Key: {token}"),
        _c("gerrit", "{0.id}", "subject messages", Step("https://{container}/a/changes/?o=MESSAGES&n=100", "", "offset S")),
        _c("buildkite", "{0.number}", "content", Step("https://api.buildkite.com/v2/organizations/{container}/builds?per_page=100", "", "link"), Step("https://api.buildkite.com/v2/organizations/{container}/pipelines/{0.pipeline.slug}/builds/{0.number}", "jobs"), Step("https://api.buildkite.com/v2/organizations/{container}/pipelines/{0.pipeline.slug}/builds/{0.number}/jobs/{1.id}/log")),
        _c("artifactory", "{0.uri}", "body", Step("https://{container}?list&deep=1", "files"), Step("https://{container}{0.uri}", form="text")),
        _c("aws_secrets_manager", "{0.Name}", "SecretString", Step("https://secretsmanager.{container}.amazonaws.com/#secretsmanager.ListSecrets", "SecretList", "token NextToken NextToken"), Step("https://secretsmanager.{container}.amazonaws.com/?SecretId={0.ARN|all}#secretsmanager.GetSecretValue"), auth="aws secretsmanager"),
        _c("circleci_artifacts", "{2.path}", "body", Step("https://circleci.com/api/v2/project/{container}/pipeline", "items", "token next_page_token page-token"), Step("https://circleci.com/api/v2/project/{container}/{0.number}/artifacts", "items", "token next_page_token page-token"), Step("{1.url}", form="text"), auth="Circle-Token: {token}"),
        _c("travis_ci", "{0.number}", "content", Step("https://api.travis-ci.com/repo/{container|all}/builds?include=build.jobs", "builds", "next @pagination.next.@href"), Step("https://api.travis-ci.com/build/{0.id}/jobs", "jobs"), Step("https://api.travis-ci.com/job/{1.id}/log"), auth="Authorization: token {token}"),
        _c("jenkins", "{0.name}/{1.number}", "body", Step("https://{container}/api/json?tree=jobs[name,url]", "jobs"), Step("https://{container}/job/{0.name}/api/json?tree=builds[number]", "builds"), Step("https://{container}/job/{0.name}/{1.number}/consoleText", form="text"), auth="Authorization: Basic {token}"),
        _c("drone", "{0.number}/{1.number}", "out", Step("https://{container}/builds?per_page=100", "", "page page"), Step("https://{container}/builds/{0.number}", "stages"), Step("https://{container}/builds/{0.number}/logs/{1.number}/1")),
        _c("huggingface", "{0.id}", "body", Step("https://huggingface.co/api/models?author={container}&limit=100", "", "link"), Step("https://huggingface.co/{0.id}/raw/main/README.md", form="text")),
        _c("sharepoint", "{0.name}", "body", Step("https://graph.microsoft.com/v1.0/drives/{container}/root/children", "value[file]", "next @odata.nextLink"), Step("https://graph.microsoft.com/v1.0/drives/{container}/items/{0.id}/content", form="text")),
        _c("teams", "{1.id}", "body.content", Step("https://graph.microsoft.com/v1.0/teams/{container}/channels", "value", "next @odata.nextLink"), Step("https://graph.microsoft.com/v1.0/teams/{container}/channels/{0.id}/messages", "value", "next @odata.nextLink")),
        _c("pypi", "{0.info.name}", "info.description info.summary", Step("https://pypi.org/pypi/{container}/json")),
        _c("gitea", "{0.number}", "title body", Step("https://{container}/issues?state=all&limit=50", "", "page page"), auth="Authorization: token {token}"),
        _c("bitbucket_cloud", "{0.path}", "body", Step("https://api.bitbucket.org/2.0/repositories/{container}/src?max_depth=20&pagelen=100", "values[type=commit_file]", "next next"), Step("https://api.bitbucket.org/2.0/repositories/{container}/src/{0.commit.hash}/{0.path}", form="text")),
        _c("bitbucket_server", "{0.id}", "title description", Step("https://{container}/pull-requests?state=ALL&limit=100", "values", "token nextPageStart start")),
        _c("azure_devops", "{0.pullRequestId}", "title description", Step("https://dev.azure.com/{container}/_apis/git/pullrequests?searchCriteria.status=all&$top=100&api-version=7.0", "value", "offset $skip"), auth="Authorization: Basic {token}"),
        _c("launchdarkly", "{0.key}", "name description variations", Step("https://app.launchdarkly.com/api/v2/flags/{container}?limit=50", "items", "next _links.next.href"), auth="Authorization: {token}"),
        _c("consul", "{0.Key}", "Value", Step("https://{container}/v1/kv/?recurse=true"), encoding="base64", auth="X-Consul-Token: {token}"),
        _c("etcd", "{0.key}", "value", Step("https://{container}/v3/kv/range?key=AA%3D%3D&range_end=AA%3D%3D#range", "kvs"), encoding="base64"),
        _c("redis", "", ""),
        _c("elasticsearch", "{0._id}", "_source", Step("https://{container}/_search?size=1000", "hits.hits", "offset from")),
        _c("aws_ssm", "", ""),
        _c("gcp_secret_manager", "{0.name}", "payload.data", Step("https://secretmanager.googleapis.com/v1/projects/{container}/secrets", "secrets", "token nextPageToken pageToken"), Step("https://secretmanager.googleapis.com/v1/{0.name}/versions/latest:access"), encoding="base64"),
        _c("azure_key_vault", "{0.id}", "value", Step("https://{container}.vault.azure.net/secrets?api-version=7.4", "value", "next nextLink"), Step("{0.id}?api-version=7.4")),
        _c("vault", "{0}", "data.data", Step("https://{container}/v1/secret/metadata?list=true", "data.keys"), Step("https://{container}/v1/secret/data/{0}"), auth="X-Vault-Token: {token}"),
        _c("doppler", "{0.key}", "value", Step("https://api.doppler.com/v3/configs/config/secrets/download?project={container}&format=json", "*")),
        _c("1password", "{1.id}", "title fields", Step("https://{container}/v1/vaults"), Step("https://{container}/v1/vaults/{0.id}/items"), Step("https://{container}/v1/vaults/{0.id}/items/{1.id}")),
        _c("lastpass", "{0.name}", "notes password", Step("https://{container}/enterpriseapi.php", "items")),
        _c("bitwarden", "{0.id}", "name notes login", Step("https://{container}/api/sync", "ciphers")),
        _c("k8s_configmaps", "{0.metadata.name}", "data", Step("kubectl get configmaps --all-namespaces -o json", "items", form="command")),
        _c("k8s_etcd", "{0.key}", "value", Step("etcdctl get --prefix /registry/secrets -w json", "kvs", form="command"), encoding="base64"),
        _c("cloudflare_workers", "{0.id}", "body", Step("https://api.cloudflare.com/client/v4/accounts/{container}/workers/scripts", "result"), Step("https://api.cloudflare.com/client/v4/accounts/{container}/workers/scripts/{0.id}", form="text")),
        _c("vercel", "{0.key}", "value", Step("https://api.vercel.com/v9/projects/{container}/env?decrypt=true", "envs", "token pagination.next until")),
        _c("netlify", "{0.key}", "values", Step("https://api.netlify.com/api/v1/accounts/{container}/env")),
        _c("railway", "{0.key}", "value", Step("https://backboard.railway.app/graphql/v2?query=query{variables(projectId:%22{container}%22)}", "data.variables.*")),
        _c("render", "{0.envVar.key}", "envVar.value", Step("https://api.render.com/v1/services/{container}/env-vars?limit=100", "", "last cursor cursor")),
        _c("fly_io", "{0.label}", "value", Step("https://api.machines.dev/v1/apps/{container}/secrets")),
        _c("supabase_env", "{0.name}", "api_key", Step("https://api.supabase.com/v1/projects/{container}/api-keys")),
        _c("github_gists", "{0.id}", "description files", Step("https://api.github.com/users/{container}/gists?per_page=100", "", "link"), Step("https://api.github.com/gists/{0.id}")),
        _c("github_issues", "{0.number}", "title body", Step("https://api.github.com/repos/{container}/issues?state=all&per_page=100", "", "link")),
        _c("github_issue_comments", "{0.id}", "body", Step("https://api.github.com/repos/{container}/issues/comments?per_page=100", "", "link")),
        _c("github_actions_logs", "{0.id}/{1.id}", "body", Step("https://api.github.com/repos/{container}/actions/runs?per_page=100", "workflow_runs", "link"), Step("https://api.github.com/repos/{container}/actions/runs/{0.id}/jobs", "jobs", "link"), Step("https://api.github.com/repos/{container}/actions/jobs/{1.id}/logs", form="text")),
        _c("gitlab_issues", "{0.iid}", "title description", Step("https://gitlab.com/api/v4/projects/{container|all}/issues?per_page=100", "", "link"), auth="PRIVATE-TOKEN: {token}"),
        _c("gitlab_ci_logs", "{0.id}", "body", Step("https://gitlab.com/api/v4/projects/{container|all}/jobs?per_page=100", "", "link"), Step("https://gitlab.com/api/v4/projects/{container|all}/jobs/{0.id}/trace", form="text"), auth="PRIVATE-TOKEN: {token}"),
        _c("discord", "{0.id}", "content", Step("https://discord.com/api/v10/channels/{container}/messages?limit=100", "", "last id before"), auth="Authorization: Bot {token}"),
        _c("mattermost", "{0.id}", "message", Step("https://{container}/posts?per_page=100", "posts", "page page 0")),
        _c("rss_feeds", "{0.link}", "title description encoded content", Step("{container}", "channel.item|entry", form="xml")),
    )
}


def dig(node, dotted: str):
    """The value at a dotted path; a name may itself hold dots."""
    if not dotted or not isinstance(node, dict):
        return node if not dotted else None
    if dotted in node:
        return node[dotted]
    parts = dotted.split(".")
    for n in range(len(parts) - 1, 0, -1):
        head = ".".join(parts[:n])
        if head in node:
            return dig(node[head], ".".join(parts[n:]))
    return None


def flatten(value) -> str:
    """A text for any JSON value: strings as they are, the rest as their leaves, a line each."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return "\n".join(f"{k}: {flatten(v)}" if not isinstance(v, (dict, list)) else flatten(v) for k, v in value.items())
    return "\n".join(map(flatten, value)) if isinstance(value, list) else str(value)


def items_of(page, where: str) -> list:
    """The items of a page: at a dotted path, the first of several by |; `*` for the pairs of an object, [field] or [field=value] for some only."""
    for one in where.split("|"):
        path, _, test = one.partition("[")
        path, star = path.removesuffix("*").rstrip("."), path.endswith("*")
        found = dig(page, path)
        if star:
            found = [{"key": k, "value": v} for k, v in found.items()] if isinstance(found, dict) else []
        elif isinstance(found, dict) and path:
            found = list(found.values()) if found and all(isinstance(v, dict) for v in found.values()) else [found]
        elif isinstance(found, dict):
            found = [found]
        if isinstance(found, list):
            name, _, value = test.rstrip("]").partition("=")
            return [x for x in found if not name or (isinstance(x, dict) and name in x and (not value or x[name] == value))]
    return []


def filled(template: str, container: str, items: list) -> str:
    """A template with the container and the items' fields; `|all` escapes slashes too."""

    def value(m: re.Match) -> str:
        name, _, how = m[1].partition("|")
        if name == "container":
            found = container
        else:
            step, _, path = name.partition(".")
            found = flatten(dig(items[int(step)], path)) if step.isdigit() and int(step) < len(items) else m[0]
        return urllib.parse.quote(found, safe="") if how == "all" else found

    return re.sub(r"\{((?:container|\d)[^{}]*)\}", value, template)


def xml_node(node: ET.Element):
    """An element as the JSON that its children make; repeated names are lists, namespaces go."""
    if not len(node):
        return (node.text or "").strip() or node.get("href", "")
    out: dict = {}
    for child in node:
        name = child.tag.rpartition("}")[2]
        value = xml_node(child)
        out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value] if name in out else value
    return out


def signed(url: str, service: str, token: str, body: bytes = b"", method: str = "GET", now: datetime | None = None) -> dict[str, str]:
    """Headers of an AWS signature (version 4); token is KEY_ID:SECRET[:SESSION], the region comes from the host or is us-east-1."""
    key_id, secret, *session = token.split(":", 2)
    parts = urllib.parse.urlsplit(url)
    at = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    region = next((p for p in (parts.hostname or "").split(".") if re.fullmatch(r"[a-z]{2}-[a-z]+-\d", p)), "us-east-1")
    headers = {"host": parts.netloc, "x-amz-content-sha256": hashlib.sha256(body).hexdigest(), "x-amz-date": at} | ({"x-amz-security-token": session[0]} if session else {})
    query = "&".join(sorted(f"{urllib.parse.quote(k, safe='-_.~')}={urllib.parse.quote(v, safe='-_.~')}" for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True)))
    names = ";".join(sorted(headers))
    request = "\n".join([method, urllib.parse.quote(urllib.parse.unquote(parts.path) or "/", safe="/-_.~"), query, *(f"{k}:{headers[k]}" for k in sorted(headers)), "", names, headers["x-amz-content-sha256"]])
    scope = f"{at[:8]}/{region}/{service}/aws4_request"
    key = b"AWS4" + secret.encode()
    for part in scope.split("/"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    mark = hmac.new(key, "\n".join(["AWS4-HMAC-SHA256", at, scope, hashlib.sha256(request.encode()).hexdigest()]).encode(), hashlib.sha256).hexdigest()
    return {k: v for k, v in headers.items() if k != "host"} | {"Authorization": f"AWS4-HMAC-SHA256 Credential={key_id}/{scope}, SignedHeaders={names}, Signature={mark}"}


class Client:
    """Answers of a service; connect and read within 30 s."""

    def __init__(self, connector: Connector, token: str = "", endpoint: str = ""):
        self.connector, self.token, self.endpoint = connector, token, endpoint

    def get(self, url: str, form: str) -> tuple[object, str]:
        """The parsed answer and its Link header; an item that is not there (404) is empty."""
        if form == "command":
            return json.loads(subprocess.run(shlex.split(url), capture_output=True, check=True, timeout=300).stdout or b"{}"), ""
        if self.endpoint:
            url = self.endpoint.rstrip("/") + "/" + re.sub(r"^\w+://[^/?]*/?", "", url)
        url, _, action = url.partition("#")
        body, method = None, "GET"
        headers = {"Accept": "*/*", "User-Agent": "quillon"}
        if action:  # a service of actions: the query is the body
            parts = urllib.parse.urlsplit(url)
            body, method = json.dumps(dict(urllib.parse.parse_qsl(parts.query))).encode(), "POST"
            url = urllib.parse.urlunsplit(parts._replace(query=""))
            headers |= {"X-Amz-Target": action, "Content-Type": "application/x-amz-json-1.1"}
        if self.connector.auth.startswith("aws ") and self.token:
            headers |= signed(url, self.connector.auth[4:], self.token, body or b"", method)
        elif self.token and not self.connector.auth.startswith("aws "):
            name, _, value = self.connector.auth.partition(": ")
            headers[name] = value.format(token=self.token)
        url = urllib.parse.quote(url, safe="%/:=&?~+!$,;'@()*[]#-._")
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers, method=method), timeout=30) as answer:
                raw, link = answer.read(), answer.headers.get("Link", "")
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return {}, ""
            raise
        if form == "text":
            return {"body": raw.decode("utf-8", "replace")}, link
        if form == "xml":
            return xml_node(ET.fromstring(raw)), link
        return json.loads(raw.removeprefix(b")]}'") or b"{}"), link

    def pages(self, step: Step, container: str, items: list) -> Iterator[object]:
        """All pages of a step."""
        first = url = filled(step.url, container, items)
        kind, *rest = step.paging.split() or [""]
        seen, asked = 0, int(rest[1]) if kind == "page" and len(rest) > 1 else 1
        if kind == "page":
            url = _with(first, rest[0], asked)
        for _ in range(MOST_PAGES):
            page, link = self.get(url, step.form)
            yield page
            found = items_of(page, step.items) if step.form != "text" else []
            seen += len(found)
            after = None
            if kind == "link":
                known = re.search(r'<([^>]+)>\s*;[^,]*rel="?next"?', link)
                after = known[1] if known else None
            elif kind == "next":
                after = dig(page, rest[0])
                after = urllib.parse.urljoin(first, after) if isinstance(after, str) and after else None
            elif kind == "token":
                cursor = dig(page, rest[0])
                after = _with(first, rest[1], cursor) if cursor not in (None, "", {}) else None
            elif kind == "last":
                cursor = dig(found[-1], rest[0]) if found else None
                after = _with(first, rest[1], cursor) if cursor else None
            elif kind == "page" and found:
                asked += 1
                after = _with(first, rest[0], asked)
            elif kind == "offset" and found:
                after = _with(first, rest[0], seen)
            if not after or after == url:
                return
            url = after

    def items(self, container: str, depth: int = 0, above: list | None = None) -> Iterator[list]:
        """The items of the last step, each with those above it."""
        above, steps = above or [], self.connector.steps
        for page in self.pages(steps[depth], container, above):
            found = [page] if steps[depth].form == "text" else items_of(page, steps[depth].items)
            for item in found:
                if depth + 1 == len(steps):
                    yield [*above, item]
                else:
                    yield from self.items(container, depth + 1, [*above, item])


def _with(url: str, name: str, value: object) -> str:
    """The address with a parameter set."""
    plain, mark, action = url.partition("#")
    plain = re.sub(rf"([?&]){re.escape(name)}=[^&]*&?", r"\1", plain).rstrip("?&")
    return f"{plain}{'&' if '?' in plain else '?'}{name}={urllib.parse.quote(str(value), safe='')}{mark}{action}"


def lines_in(connector: Connector, items: list) -> Iterator[tuple[str, int, str]]:
    """(path, line, text) of an item, with the items above it for its name."""
    key = filled(connector.key, "", items)
    if connector.encoding == "base64" and connector.name in ("etcd", "k8s_etcd"):  # their keys are coded too
        try:
            key = base64.b64decode(key, validate=True).decode()
        except ValueError:
            pass
    for name in connector.texts:
        text = flatten(dig(items[-1], name))
        if connector.encoding == "base64":
            try:
                text = base64.b64decode(text).decode("utf-8", "replace")
            except ValueError:
                continue
        for n, line in enumerate(text.splitlines(), 1):
            yield f"{connector.name}:{key}#{name.rpartition('.')[2]}", n, line


def rows_of(connector: Connector, page) -> Iterator[tuple[str, int, str]]:
    """(path, line, text) of one page of the last step, whose items name themselves."""
    for item in items_of(page, connector.steps[-1].items):
        yield from lines_in(connector, [item] * len(connector.steps))


class _Container(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.connector = CONNECTORS[options["connector"]]
        self.containers = [c for c in options.get("containers", "default").split(",") if c]
        self.token, self.fixture = options.get("token", ""), options.get("fixture")
        self.most, self.endpoint = int(options.get("max_items", "0")), options.get("endpoint", "")

    def partitions(self) -> list[InputPartition]:
        return [_Container(c) for c in self.containers] if self.connector.steps else []

    def read(self, partition: _Container | None) -> Iterator[tuple[str, int, str]]:
        if partition is None:  # a source without an address has no partitions
            return
        seen: set[str] = set()
        for path, line, text in self.rows(partition.name):
            seen.add(path)
            if self.most and len(seen) > self.most:
                return
            yield path, line, text

    def rows(self, container: str) -> Iterator[tuple[str, int, str]]:
        if self.fixture:
            with open(self.fixture) as f:
                pages = json.load(f).get(container, [])
            for page in pages:
                yield from rows_of(self.connector, page)
            return
        for items in Client(self.connector, self.token, self.endpoint).items(container):
            yield from lines_in(self.connector, items)


class ConnectorSource(DataSource):
    """All connectors, chosen by the option `connector`."""

    @classmethod
    def name(cls) -> str:
        return "quillon"

    def schema(self) -> str:
        return "path string, line int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
