"""Types of the stored and the wire records."""

from __future__ import annotations

SUBMISSION = (
    "id string, project_id string, kind string, source string, body string, cluster_text string, user_id string, attributed boolean, mrr double, "
    "client_ts timestamp, received_at timestamp, route string, app_version string, platform string, fingerprint string, embedding array<double>, ingest_seq bigint"
)
REQUIRED = ("id", "project_id", "kind", "source", "body", "cluster_text", "user_id", "client_ts")

ENVELOPE = (
    "v int, sentAt string, project string, events array<struct<id: string, kind: string, source: string, clientTs: string, body: string, "
    "user: struct<externalId: string, anonId: string, traits: map<string, string>>, "
    "context: struct<route: string, appVersion: string, sdkVersion: string, platform: string, osVersion: string, device: string, locale: string, viewport: array<int>, custom: map<string, string>>, "
    "element: struct<selector: string, bbox: array<double>, component: string, computed: map<string, string>>, "
    "frustration: struct<score: double, signals: map<string, int>>, redaction: struct<rules: array<string>, maskedCount: int>, captureRef: string>>"
)
PROTOCOL_VERSION = 0
KINDS = ("feature_request", "bug", "praise", "question", "rage")
SOURCES = ("nub", "shortcut", "picker", "selection", "frustration_prompt", "shake", "api", "import", "support_inbox")
