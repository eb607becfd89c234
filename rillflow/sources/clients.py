"""Readers of services without a Spark format, behind one Python data source.

A client is a class with ``pages(config)``: an iterator of lists of JSON texts that ends for bounded
services and, for polled ones, after ``maxPolls`` polls (a batch) or never (a stream). Clients of
libraries that are not installed raise at use, naming the library.
"""

from __future__ import annotations

import base64
import email
import json
import socket
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def http(url: str, *, data: bytes | None = None, headers: dict | None = None, method: str | None = None, timeout: float = 60):
    """A request's body as JSON, or None if it is empty."""
    request = urllib.request.Request(url, data=data, headers=headers or {}, method=method)
    with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
        body = r.read()
    return json.loads(body) if body else None


def credential(config: dict) -> dict:
    """Secrets by id: ``credentials`` in the settings maps ids to {username, password, key, ...}."""
    return (config.get("credentials") or {}).get(config.get("credentialId"), {})


def basic(config: dict) -> dict:
    c = credential(config)
    if c.get("key"):
        return {"Authorization": f"Bearer {c['key']}"}
    if c.get("username"):
        return {"Authorization": "Basic " + base64.b64encode(f"{c['username']}:{c.get('password', '')}".encode()).decode()}
    return {}


def library(name: str):
    import importlib

    try:
        return importlib.import_module(name)
    except ImportError:
        raise RuntimeError(f"this connector needs the Python library {name}") from None


def splunk(config: dict) -> Iterator[list[str]]:
    """A search job: created, awaited, then read page by page."""
    root, head = config["splunkUrl"].rstrip("/"), basic(config)
    form = {"search": config["searchQuery"], "output_mode": "json"} | {k: config[v] for k, v in (("earliest_time", "earliestTime"), ("latest_time", "latestTime")) if config.get(v)}
    job = http(f"{root}/services/search/jobs", data=urllib.parse.urlencode(form).encode(), headers=head)["sid"]
    until = time.time() + config.get("jobInitTimeoutMs", 300_000) / 1000
    while not http(f"{root}/services/search/jobs/{job}?output_mode=json", headers=head)["entry"][0]["content"]["isDone"]:
        if time.time() > until:
            raise TimeoutError("the search job did not end in time")
        time.sleep(1)
    at, size = 0, config.get("batchSize", 10_000)
    while rows := http(f"{root}/services/search/jobs/{job}/results?output_mode=json&offset={at}&count={size}", headers=head)["results"]:
        yield [json.dumps(r) for r in rows]
        at += len(rows)


def elasticsearch(config: dict) -> Iterator[list[str]]:
    """The scroll API; ``_id`` and ``_index`` come along as metadata."""
    root, head = config["host"].rstrip("/"), basic(config) | {"Content-Type": "application/json"}
    query = json.loads(config["query"]) if config.get("query") else {"query": {"match_all": {}}}
    keep = config.get("scrollTimeout", "5m")
    page = http(f"{root}/{config['index']}/_search?scroll={keep}&size={config.get('batchSize', 1000)}", data=json.dumps(query).encode(), headers=head)
    while page["hits"]["hits"]:
        yield [json.dumps(h["_source"] | {"__md_id": h["_id"], "__md_index": h["_index"]}) for h in page["hits"]["hits"]]
        page = http(f"{root}/_search/scroll", data=json.dumps({"scroll": keep, "scroll_id": page["_scroll_id"]}).encode(), headers=head)


def azure_monitor(config: dict) -> Iterator[list[str]]:
    """One query; every table's rows as text fields."""
    c = credential(config)
    form = {"grant_type": "client_credentials", "client_id": c.get("username"), "client_secret": c.get("password"), "scope": "https://api.loganalytics.io/.default"}
    login = config.get("loginUrl", "https://login.microsoftonline.com").rstrip("/")
    token = http(f"{login}/{config['tenantId']}/oauth2/v2.0/token", data=urllib.parse.urlencode(form).encode())["access_token"]
    root = config.get("apiUrl", "https://api.loganalytics.io").rstrip("/")
    got = http(f"{root}/v1/workspaces/{config['workspaceId']}/query", data=json.dumps({"query": config["kqlQuery"]}).encode(), headers={"Authorization": f"Bearer {token}", "Content-Type": "application/json"})
    for t in got["tables"]:
        names = [c["name"] for c in t["columns"]]
        yield [json.dumps({n: None if v is None else str(v) for n, v in zip(names, row)}) for row in t["rows"]]


def syslog_udp(config: dict) -> Iterator[list[str]]:
    """Datagrams of a UDP port, each one event."""
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind((config.get("host", "0.0.0.0"), config.get("port", 514)))
        s.settimeout(config.get("pollSeconds", 1))
        while True:
            page: list[str] = []
            try:
                while len(page) < config.get("queueCapacity", 10_000):
                    page.append(json.dumps({"__raw__": s.recv(config.get("bufferSize", 65_535)).decode(config.get("encoding", "UTF-8"), "replace")}))
            except TimeoutError:
                pass
            yield page


def imap(config: dict) -> Iterator[list[str]]:
    """Messages that match the search, polled; each is marked as read if asked."""
    import imaplib

    c = credential(config)
    box = (imaplib.IMAP4_SSL if config.get("useSsl", True) else imaplib.IMAP4)(config["host"], config.get("port", 993))
    box.login(c.get("username", ""), c.get("password", ""))
    while True:
        box.select(config.get("folder", "INBOX"))
        _, found = box.search(None, config.get("searchCriteria") or "UNSEEN")
        page = []
        for n in found[0].split()[: config.get("maxMessages", 100)]:
            _, data = box.fetch(n, "(RFC822)" if config.get("markAsRead", True) else "(BODY.PEEK[])")
            page.append(json.dumps(message_record(email.message_from_bytes(data[0][1]), config.get("includeAttachments", False))))
        yield page
        time.sleep(config.get("pollIntervalMs", 60_000) / 1000)


def message_record(m, attachments: bool) -> dict:
    """A mail as an event."""
    body: dict = {"text/plain": None, "text/html": None}
    files = []
    for part in m.walk():
        kind, content = part.get_content_type(), part.get_payload(decode=True)
        if part.get_filename():
            if attachments and content is not None:
                files.append({"filename": part.get_filename(), "contentType": kind, "contentBase64": base64.b64encode(content).decode()})
        elif kind in body and body[kind] is None and content is not None:
            body[kind] = content.decode(part.get_content_charset() or "utf-8", "replace")
    split = lambda h: [a.strip() for a in (m.get(h) or "").split(",") if a.strip()]
    out = {"messageId": m.get("Message-ID"), "from": m.get("From"), "to": split("To"), "cc": split("Cc"), "subject": m.get("Subject"), "bodyText": body["text/plain"], "bodyHtml": body["text/html"], "headers": dict(m.items()), "receivedDate": m.get("Date")}
    return out | ({"attachments": files} if attachments else {})


def ldap(config: dict) -> Iterator[list[str]]:
    """A paged search; attributes of several values are lists."""
    ldap3 = library("ldap3")
    c = credential(config)
    link = ldap3.Connection(ldap3.Server(config["ldapUrl"]), c.get("username"), c.get("password"), auto_bind=True)
    found = link.extend.standard.paged_search(config["baseDn"], config.get("searchFilter", "(objectClass=*)"), attributes=config.get("attributes") or ["*"], paged_size=config.get("pageSize", 500), generator=True)
    page = []
    for e in found:
        if e.get("type") == "searchResEntry":
            page.append(json.dumps({"dn": e["dn"]} | {k: v[0] if isinstance(v, list) and len(v) == 1 else v for k, v in e["attributes"].items()}, default=str))
            if len(page) >= 500:
                yield page
                page = []
    yield page


def sqs(config: dict) -> Iterator[list[str]]:
    """Long polling; a page is deleted from the queue when the next is asked for, that is after it was taken over."""
    client = library("boto3").client("sqs", region_name=config.get("regionStr") or config.get("region"))
    while True:
        got = client.receive_message(QueueUrl=config["queueUrl"], MaxNumberOfMessages=config.get("maxNumberOfMessages", 10), WaitTimeSeconds=config.get("waitTimeSeconds", 20)).get("Messages", [])
        yield [m["Body"] for m in got]
        if got:
            client.delete_message_batch(QueueUrl=config["queueUrl"], Entries=[{"Id": str(i), "ReceiptHandle": m["ReceiptHandle"]} for i, m in enumerate(got)])


def pubsub(config: dict) -> Iterator[list[str]]:
    client = library("google.cloud.pubsub_v1").SubscriberClient()
    path = client.subscription_path(config["projectId"], config["subscription"])
    while True:
        got = client.pull(subscription=path, max_messages=config.get("maxMessages", 1000)).received_messages
        yield [m.message.data.decode() for m in got]
        if got:
            client.acknowledge(subscription=path, ack_ids=[m.ack_id for m in got])


def mqtt(config: dict) -> Iterator[list[str]]:
    import queue

    paho = library("paho.mqtt.client")
    inbox: queue.Queue = queue.Queue(config.get("receiveQueueCapacity", 10_000))
    client = paho.Client(client_id=config.get("clientId", ""), protocol=paho.MQTTv5)
    client.on_message = lambda c, u, m: inbox.put(m.payload.decode())
    url = urllib.parse.urlparse(config["brokerUrl"])
    client.connect(url.hostname, url.port or 1883)
    client.subscribe(config["topicFilter"], config.get("qos", 1))
    client.loop_start()
    yield from drained(inbox, config)


def activemq(config: dict) -> Iterator[list[str]]:
    import queue

    stomp = library("stomp")
    inbox: queue.Queue = queue.Queue(10_000)

    class Listener(stomp.ConnectionListener):
        def on_message(self, frame):
            inbox.put(frame.body)

    url, c = urllib.parse.urlparse(config["brokerUrl"]), credential(config)
    link = stomp.Connection([(url.hostname, url.port or 61613)])
    link.set_listener("", Listener())
    link.connect(c.get("username"), c.get("password"), wait=True)
    link.subscribe(f"/{config.get('destinationType', 'QUEUE').lower()}/{config['destination']}", id="1", ack="auto")
    yield from drained(inbox, config)


def drained(inbox, config: dict) -> Iterator[list[str]]:
    import queue

    while True:
        page: list[str] = []
        try:
            while len(page) < config.get("maxBatchSize", 1000):
                page.append(inbox.get(timeout=config.get("receiveTimeoutMs", 1000) / 1000))
        except queue.Empty:
            pass
        yield page


CLIENTS = {"splunk": splunk, "elasticsearch": elasticsearch, "azuremonitor": azure_monitor, "syslogudp": syslog_udp, "imap": imap, "ldap": ldap, "sqs": sqs, "pubsub": pubsub, "mqtt": mqtt, "activemq": activemq}
BOUNDED = {"splunk", "elasticsearch", "azuremonitor", "ldap"}


class OnePartition(InputPartition):
    pass


class ClientReader(DataSourceReader):
    def __init__(self, client: str, config: dict):
        self.client, self.config = client, config

    def partitions(self):
        return [OnePartition(0)]

    def read(self, partition):
        polls = None if self.client in BOUNDED else self.config.get("maxPolls", 1)
        for i, page in enumerate(CLIENTS[self.client](self.config)):
            for text in page:
                yield (text,)
            if polls is not None and i + 1 >= polls:
                return


class ClientStream(SimpleDataSourceStreamReader):
    """Pages in order; the offset counts pages, and pages are kept until they are committed."""

    def __init__(self, client: str, config: dict):
        self.source, self.pages = CLIENTS[client](config), {}

    def initialOffset(self):
        return {"page": 0}

    def read(self, start):
        at = start["page"]
        if at not in self.pages:
            self.pages[at] = next(self.source, [])
        return iter([(t,) for t in self.pages[at]]), {"page": at + 1}

    def readBetweenOffsets(self, start, end):
        return iter([(t,) for at in range(start["page"], end["page"]) for t in self.pages.get(at, [])])

    def commit(self, end):
        self.pages = {k: v for k, v in self.pages.items() if k >= end["page"]}


class ClientSource(DataSource):
    """``spark.read.format("rillflow_client").option("client", ...).option("config", json)``: one column, ``value``."""

    @classmethod
    def name(cls):
        return "rillflow_client"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return ClientReader(self.options["client"], json.loads(self.options.get("config", "{}")))

    def simpleStreamReader(self, schema):
        return ClientStream(self.options["client"], json.loads(self.options.get("config", "{}")))
