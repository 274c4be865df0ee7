"""Registered query on remote sources: a page of every service, and the lines it must yield.

Pages are of a connector's last step, with what names an item in it; paging and
chains are tested against a server.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd

from ..sources import connectors
from .base import register
from .contents import expected, filled

# (connector, page, lines that it must yield: path after the name, text); djE= is v1 in base64
PAGES: list[tuple[str, str, list[tuple[str, str]]]] = [
    ("github", '{"path": "p", "content": "djE="}', [("p#content", "v1")]),
    ("gitlab", '{"path": "p", "content": "djE="}', [("p#content", "v1")]),
    ("s3", '{"Key": "k", "body": "{v}"}', [("k#body", "{v}")]),
    ("gcs", '{"name": "n", "body": "{v}"}', [("n#body", "{v}")]),
    ("azure_blob", '{"Name": "n", "body": "{v}"}', [("n#body", "{v}")]),
    ("oss", '{"Key": "k", "body": "{v}"}', [("k#body", "{v}")]),
    ("confluence", '{"results": [{"id": "7", "title": "t", "body": {"storage": {"value": "{v}"}}}]}', [("7#title", "t"), ("7#value", "{v}")]),
    ("slack", '{"messages": [{"ts": "1.5", "text": "{v}"}]}', [("1.5#text", "{v}")]),
    ("jira", '{"issues": [{"key": "K-1", "fields": {"summary": "{v}", "description": "d", "comment": {"comments": [{"body": "c"}]}}}]}', [("K-1#summary", "{v}"), ("K-1#description", "d"), ("K-1#comments", "body: c")]),
    ("postman", '{"collection": {"item": [{"name": "n", "request": {"url": "{v}"}}]}}', [("n#request", "url: {v}")]),
    ("gerrit", '[{"id": "i", "subject": "{v}", "messages": [{"message": "m"}]}]', [("i#subject", "{v}"), ("i#messages", "message: m")]),
    ("buildkite", '{"number": 5, "content": "{v}"}', [("5#content", "{v}")]),
    ("artifactory", '{"uri": "/x", "body": "{v}"}', [("/x#body", "{v}")]),
    ("aws_secrets_manager", '{"Name": "n", "SecretString": "{v}"}', [("n#SecretString", "{v}")]),
    ("circleci_artifacts", '{"path": "p", "body": "{v}"}', [("p#body", "{v}")]),
    ("travis_ci", '{"number": "3", "content": "{v}"}', [("3#content", "{v}")]),
    ("jenkins", '{"name": "j", "number": 2, "body": "{v}"}', [("j/2#body", "{v}")]),
    ("drone", '[{"number": 1, "out": "{v}"}]', [("1/1#out", "{v}")]),
    ("huggingface", '{"id": "a/b", "body": "{v}"}', [("a/b#body", "{v}")]),
    ("sharepoint", '{"name": "f", "body": "{v}"}', [("f#body", "{v}")]),
    ("teams", '{"value": [{"id": "m", "body": {"content": "{v}"}}]}', [("m#content", "{v}")]),
    ("pypi", '{"info": {"name": "p", "description": "{v}", "summary": "s"}}', [("p#description", "{v}"), ("p#summary", "s")]),
    ("gitea", '[{"number": 1, "title": "{v}", "body": "b"}]', [("1#title", "{v}"), ("1#body", "b")]),
    ("bitbucket_cloud", '{"path": "p", "body": "{v}"}', [("p#body", "{v}")]),
    ("bitbucket_server", '{"values": [{"id": 1, "title": "{v}", "description": "d"}]}', [("1#title", "{v}"), ("1#description", "d")]),
    ("azure_devops", '{"value": [{"pullRequestId": 4, "title": "{v}"}]}', [("4#title", "{v}")]),
    ("launchdarkly", '{"items": [{"key": "f", "name": "{v}"}]}', [("f#name", "{v}")]),
    ("consul", '[{"Key": "k", "Value": "djE="}]', [("k#Value", "v1")]),
    ("etcd", '{"kvs": [{"key": "aw==", "value": "djE="}]}', [("k#value", "v1")]),
    ("elasticsearch", '{"hits": {"hits": [{"_id": "1", "_source": {"f": "{v}"}}]}}', [("1#_source", "f: {v}")]),
    ("gcp_secret_manager", '{"name": "n", "payload": {"data": "djE="}}', [("n#data", "v1")]),
    ("azure_key_vault", '{"id": "i", "value": "{v}"}', [("i#value", "{v}")]),
    ("doppler", '{"A": "{v}"}', [("A#value", "{v}")]),
    ("1password", '{"id": "i", "title": "{v}", "fields": [{"value": "w"}]}', [("i#title", "{v}"), ("i#fields", "value: w")]),
    ("lastpass", '{"items": [{"name": "n", "notes": "{v}"}]}', [("n#notes", "{v}")]),
    ("bitwarden", '{"ciphers": [{"id": "c", "name": "{v}"}]}', [("c#name", "{v}")]),
    ("k8s_configmaps", '{"items": [{"metadata": {"name": "m"}, "data": {"a": "{v}"}}]}', [("m#data", "a: {v}")]),
    ("k8s_etcd", '{"kvs": [{"key": "aw==", "value": "djE="}]}', [("k#value", "v1")]),
    ("cloudflare_workers", '{"id": "w", "body": "{v}"}', [("w#body", "{v}")]),
    ("vercel", '{"envs": [{"key": "K", "value": "{v}"}]}', [("K#value", "{v}")]),
    ("netlify", '[{"key": "K", "values": [{"value": "{v}"}]}]', [("K#values", "value: {v}")]),
    ("railway", '{"data": {"variables": {"K": "{v}"}}}', [("K#value", "{v}")]),
    ("render", '[{"envVar": {"key": "K", "value": "{v}"}}]', [("K#value", "{v}")]),
    ("fly_io", '[{"label": "L", "value": "{v}"}]', [("L#value", "{v}")]),
    ("supabase_env", '[{"name": "n", "api_key": "{v}"}]', [("n#api_key", "{v}")]),
    ("github_gists", '{"id": "g", "description": "{v}"}', [("g#description", "{v}")]),
    ("github_issues", '[{"number": 2, "title": "{v}", "body": "b"}]', [("2#title", "{v}"), ("2#body", "b")]),
    ("github_issue_comments", '[{"id": 9, "body": "{v}"}]', [("9#body", "{v}")]),
    ("github_actions_logs", '{"id": 3, "body": "{v}"}', [("3/3#body", "{v}")]),
    ("gitlab_issues", '[{"iid": 2, "title": "{v}"}]', [("2#title", "{v}")]),
    ("gitlab_ci_logs", '{"id": 1, "body": "{v}"}', [("1#body", "{v}")]),
    ("discord", '[{"id": "d", "content": "{v}"}]', [("d#content", "{v}")]),
    ("mattermost", '{"posts": {"a": {"id": "a", "message": "{v}"}}}', [("a#message", "{v}")]),
    ("rss_feeds", '{"channel": {"item": {"link": "l", "title": "{v}", "description": "d"}}}', [("l#title", "{v}"), ("l#description", "d")]),
]


@register("connector_lines", expected([(f"{name}:{path}", 1, text) for name, _, found in PAGES for path, text in found], "path line text"))
def connector_lines(spark, sf_dir):
    """Lines of a page of every service."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for name, text in zip(pdf["path"], pdf["text"], strict=True) for r in connectors.rows_of(connectors.CONNECTORS[name], json.loads(text))]
            yield pd.DataFrame(rows, columns=["path", "line", "text"]).astype({"line": "int32"})

    return filled(spark, sf_dir, [(name, page) for name, page, _ in PAGES]).mapInPandas(run, "path string, line int, text string")
