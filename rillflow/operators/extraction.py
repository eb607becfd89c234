"""Extraction rules of the parser node.

A rule reads one text into named values. Rules whose names are known from their settings also build
Columns (``columns``); rules whose names depend on the text run in Arrow batches (``read``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grok import compile_grok, expand
from ..functions.syntax import ExpressionError, unescape

TEXT = T.StringType()


class Rule:
    """``columns(text)`` gives ({name: (Column, type)}, failure message Column or None), or is None for dynamic rules."""

    columns = None

    def read(self, text: str) -> dict:
        raise NotImplementedError


def only_if(good: Column, message: str) -> Column:
    return F.when(~F.coalesce(good, F.lit(False)), F.lit(f"failed to parse input: {message}"))


class GrokRule(Rule):
    def __init__(self, config: dict):
        self.grok = compile_grok(config["grokExpression"])
        self.pattern = re.compile(python_regex(expand(config["grokExpression"])))
        self.names = {f"g{i}": n for i, (n, _) in enumerate(self.grok.fields)}

    def columns(self, text):
        record = self.grok.record(text)
        return {n: (record.getField(n), TEXT) for n, _ in self.grok.fields}, only_if(self.grok.matches(text), "the grok expression does not match")

    def read(self, text):
        m = self.pattern.search(text)
        if not m:
            raise ValueError("the grok expression does not match")
        out: dict = {}
        for name, value in m.groupdict().items():
            out.setdefault(GROUP_NAMES.get(name, name), value or None)
        return out


GROUP_NAMES: dict[str, str] = {}


def python_regex(expanded: str) -> str:
    """Named groups in Python's spelling; a name used again becomes a plain group, other characters are escaped in a name of its own."""
    seen: set[str] = set()

    def one(m: re.Match) -> str:
        name = m[1]
        if name in seen:
            return "("
        seen.add(name)
        plain = name if name.isidentifier() else "f_" + name.encode().hex()
        GROUP_NAMES[plain] = name
        return f"(?P<{plain}>"

    return re.sub(r"\(\?<([A-Za-z][\w.@\[\]-]*)>", one, expanded)


class JsonRule(Rule):
    def __init__(self, config: dict):
        self.name = config["outputFieldName"]

    def columns(self, text):
        parsed = F.try_parse_json(text)
        return {self.name: (parsed, T.VariantType())}, only_if(parsed.isNotNull(), "not JSON")

    def read(self, text):
        return {self.name: json.loads(text)}


def quoted_split(text: Column, separator: str) -> Column:
    """Fields between separators that are not inside double quotes."""
    return F.split(text, "\\Q" + separator + '\\E(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)


def bare(field: Column) -> Column:
    inner = F.replace(F.substring(field, F.lit(2), F.char_length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"') & field.endswith('"') & (F.char_length(field) >= 2), inner).otherwise(field)


class DelimitedRule(Rule):
    def __init__(self, config: dict):
        self.separator, self.names = config["delimiter"], list(config["columns"])

    def columns(self, text):
        first = F.regexp_extract(text, r'^((?:[^"\r\n]|"(?:[^"]|"")*")*)', 1)  # a record ends at its line
        parts = quoted_split(first, self.separator)
        fields = {n: (bare(F.get(parts, F.lit(i))), TEXT) for i, n in enumerate(self.names)}
        return fields, only_if(F.size(parts) <= len(self.names), f"more values than the {len(self.names)} columns defined")

    def read(self, text):
        parts = split_outside_quotes(re.match(r'(?:[^"\r\n]|"(?:[^"]|"")*")*', text)[0], self.separator)
        if len(parts) > len(self.names):
            raise ValueError(f"more values than the {len(self.names)} columns defined")
        return dict(zip(self.names, parts))


def split_outside_quotes(text: str, separator: str) -> list[str]:
    parts = re.split(re.escape(separator) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', text)
    return [p[1:-1].replace('""', '"') if len(p) > 1 and p[0] == p[-1] == '"' else p for p in parts]


# The firewall vendor's documented traffic log fields, in order.
TRAFFIC_FIELDS = """
FUTURE_USE receiveTime serialNumber type subtype FUTURE_USE generatedTime sourceAddress destinationAddress natSourceIP
natDestinationIP ruleName sourceUser destinationUser application virtualSystem sourceZone destinationZone inboundInterface
outboundInterface logAction FUTURE_USE sessionID repeatCount sourcePort destinationPort natSourcePort natDestinationPort
flags protocol action bytes bytesSent bytesReceived packets startTime elapsedTime category FUTURE_USE sequenceNumber
actionFlags sourceCountry destinationCountry FUTURE_USE packetsSent packetsReceived sessionEndReason
deviceGroupHierarchyLevel1 deviceGroupHierarchyLevel2 deviceGroupHierarchyLevel3 deviceGroupHierarchyLevel4
virtualSystemName deviceName actionSource sourceVMUUID destinationVMUUID tunnelID_IMSI monitorTag_IMEI parentSessionID
parentStartTime tunnelType sctpAssociationID sctpChunks sctpChunksSent sctpChunksReceived ruleUUID http2Connection
appFlapCount policyID linkSwitches sdwanCluster sdwanDeviceType sdwanClusterType sdwanSite dynamicUserGroupName xffAddress
sourceDeviceCategory sourceDeviceProfile sourceDeviceModel sourceDeviceVendor sourceDeviceOSFamily sourceDeviceOSVersion
sourceHostname sourceMacAddress destinationDeviceCategory destinationDeviceProfile destinationDeviceModel
destinationDeviceVendor destinationDeviceOSFamily destinationDeviceOSVersion destinationHostname destinationMacAddress
containerID podNamespace podName sourceExternalDynamicList destinationExternalDynamicList hostID userDeviceSerialNumber
sourceDynamicAddressGroup destinationDynamicAddressGroup sessionOwner highResolutionTimestamp aSliceServiceType
aSliceDifferentiator applicationSubcategory applicationCategory applicationTechnology applicationRisk
applicationCharacteristic applicationContainer tunneledApplication applicationSaaS applicationSanctionedState offloaded
""".split()


class TrafficRule(Rule):
    """``panw_traffic``: quote-aware CSV with fixed names; ``$$ k=v`` metadata makes the names depend on the text."""

    def __init__(self, config: dict):
        self.metadata = list(config.get("metadataKeys") or [])

    def columns(self, text):
        line = F.regexp_replace(F.regexp_replace(text, r"(?s) \$\$ .*$", ""), ",+$", "")
        parts = quoted_split(line, ",")
        fields = {n: (bare(F.get(parts, F.lit(i))), TEXT) for i, n in enumerate(TRAFFIC_FIELDS) if n != "FUTURE_USE"}
        extra = F.when(F.contains(text, F.lit(" $$ ")), F.regexp_replace(text, r"(?s)^.*? \$\$ ", ""))
        for key in self.metadata:
            fields[f"metadata_{key}"] = (F.nullif(F.regexp_extract(extra, rf"(?:^| ){re.escape(key)}=([^ ]*)", 1), F.lit("")), TEXT)
        return fields, None

    def read(self, text):
        line, _, metadata = text.partition(" $$ ")
        parts = split_outside_quotes(line.rstrip(","), ",")
        out = {n: v for n, v in zip(TRAFFIC_FIELDS, parts) if n != "FUTURE_USE"}
        return out | {"metadata_" + k: v for k, sep, v in (x.partition("=") for x in metadata.split(" ")) if sep}


class KvRule(Rule):
    """``kv_pair``: pairs with configurable separators; quotes hide separators, repeated keys gather in a list."""

    def __init__(self, config: dict):
        self.pair, self.kv = (unescape(f'"{config[k]}"') for k in ("pairSeparator", "kvSeparator"))
        self.token = re.compile(rf'(?P<quote>(?<!\\)")|(?P<kv>{re.escape(self.kv)})|(?P<pair>{re.escape(self.pair)})')

    def read(self, text):
        # A pair separator ends a value only if a further key follows it, so the last one before each key counts.
        out: dict = {}
        key_at, kv_at, last_pair, inside = 0, None, None, False
        for m in self.token.finditer(text):
            if m.lastgroup == "quote":
                inside = not inside
            elif inside:
                continue
            elif m.lastgroup == "pair":
                last_pair = m if kv_at is not None else None
            elif kv_at is None:
                kv_at = m
            elif last_pair is not None:
                self.add(out, text[key_at : kv_at.start()], text[kv_at.end() : last_pair.start()])
                key_at, kv_at, last_pair = last_pair.end(), m, None
        if kv_at is not None:
            self.add(out, text[key_at : kv_at.start()], text[kv_at.end() :])
        return out

    @staticmethod
    def add(out: dict, key: str, value: str) -> None:
        clean = lambda s: s[1:-1].replace('\\"', '"') if len(s) > 1 and s[0] == s[-1] == '"' else s
        if not key.strip():
            return
        k, v = clean(key.strip()), clean(value.strip())
        if k not in out:
            out[k] = v
        else:
            out[k] = [*(out[k] if isinstance(out[k], list) else [out[k]]), v]


# --- syslog -------------------------------------------------------------------------------------

FIELD_OF = {"PRIORITY": "priority", "VERSION": "version", "TIMESTAMP": "timestamp", "DEVICE": "deviceId", "APP": "appName", "PROC_ID": "procId", "MSG_ID": "msgId", "STRUCTURED_DATA": "structuredData"}
ELEMENT = r'\[(?:[^\]"\\]|\\.|"(?:[^"\\]|\\.)*")*\]'


def time_regex(pattern: str) -> str:
    """A regular expression for texts of a date-time pattern."""
    out = []
    for m in re.finditer(r"'((?:[^']|'')*)'|([A-Za-z])\2*|.", pattern, re.DOTALL):
        run, letter = m[0], m[2]
        if letter is None:
            out.append(re.escape((m[1].replace("''", "'") or "'") if m[1] is not None else run))
        elif letter in "Ee" or letter in "ML" and len(run) > 2:
            out.append(r"[A-Za-z]+" if len(run) != 3 else r"[A-Za-z]{3}")
        elif letter == "a":
            out.append(r"[AaPp][Mm]")
        elif letter in "zVO":
            out.append(r"[A-Za-z0-9:+/_-]+")
        elif letter in "ZXx":
            out.append(r"(?:Z|[+-][0-9]{2}:?(?:[0-9]{2})?)")
        else:
            out.append(r"[0-9]{1,2}" if len(run) == 1 and letter not in "yuS" else r"[0-9]+" if len(run) == 1 else rf"[0-9]{{{len(run)}}}")
    return "".join(out)


class SyslogRule(Rule):
    """Header components in order, an optional delimiter, and the rest as ``content``: one regular expression."""

    def __init__(self, config: dict):
        self.parts = list(config["componentList"])
        delimiter = config.get("messageBodyDelimiter")
        if "TIMESTAMP" in self.parts and not config.get("timestampPattern"):
            raise ExpressionError("syslog: TIMESTAMP needs a timestampPattern")
        if "PRIORITY" in self.parts[1:]:
            raise ExpressionError("syslog: PRIORITY comes first")
        # a structured-data name may be any run of letters, so class brackets of the token are escaped
        token = r"[^\s" + (re.escape(delimiter) if delimiter else "") + "]+"
        regex = {"PRIORITY": r"<([0-9]+)>", "TIMESTAMP": f"({time_regex(config.get('timestampPattern') or '')})", "STRUCTURED_DATA": rf"(-|{ELEMENT}(?:\s*{ELEMENT})*)"}
        body = r"\s*".join(regex.get(p, f"({token})") for p in self.parts)
        self.regex = r"(?s)^\s*" + body + r"\s*" + (re.escape(delimiter) + r"\s*" if delimiter else "") + r"(.*?)\s*$"
        self.compiled = re.compile(self.regex)
        if "STRUCTURED_DATA" not in self.parts:
            self.columns = self._columns

    def _columns(self, text):
        names = [FIELD_OF[p] for p in self.parts] + ["content"]
        joined = F.split(F.regexp_replace(text, self.regex, "\u0001".join(f"${i + 1}" for i in range(len(names)))), "\u0001", -1)
        fields = {n: (F.get(joined, F.lit(i)), TEXT) for i, n in enumerate(names)}
        if "priority" in fields:
            fields["priority"] = (fields["priority"][0].try_cast("bigint"), T.LongType())
        return fields, only_if(text.rlike(self.regex), "not a syslog line of the given components")

    def read(self, text):
        m = self.compiled.match(text)
        if not m:
            raise ValueError("not a syslog line of the given components")
        out: dict = {FIELD_OF[p]: v for p, v in zip(self.parts, m.groups())}
        if "priority" in out:
            out["priority"] = int(out["priority"])
        if out.get("structuredData", "-") != "-":
            out["structuredData"] = dict(structured(out["structuredData"]))
        return out | {"content": m[len(self.parts) + 1]}


def structured(text: str) -> Iterator[tuple[str, dict]]:
    """SD-ID and parameters of each element."""
    for element in re.findall(ELEMENT, text):
        m = re.fullmatch(r"\[([^\s\]]+)((?:\s+[^\s=\]]+=\"(?:[^\"\\]|\\.)*\")*)\s*\]", element)
        if not m:
            raise ValueError("malformed structured data")
        yield m[1], {k: re.sub(r'\\(["\\\]])', r"\1", v) for k, v in re.findall(r'\s+([^\s=\]]+)="((?:[^"\\]|\\.)*)"', m[2])}


# --- CEF ----------------------------------------------------------------------------------------

CEF_HEADER = ("version", "deviceVendor", "deviceProduct", "deviceVersion", "deviceEventClassId", "name", "severity")
CEF_LINE = re.compile(r"(?s)((?:[^|\\]|\\.)*)" + r"\|((?:[^|\\]|\\.)*)" * 6 + r"\|(.*)")
#: a key follows a blank and has none itself; its value runs to the blank before the next key
CEF_PAIR = re.compile(r'(?s)\s*([^=]*?)=(?:"([^"]*)(?:"|$)|((?!["=\s]).*?)(?=\s[^\s=]+=|$)|(?=[=\s]|$))')


def maybe_int(text: str):
    return int(text) if re.fullmatch(r"[+-]?\d{1,10}", text) else text


class CefRule(Rule):
    def __init__(self, config: dict):
        pass

    def read(self, text):
        m = CEF_LINE.match(text.strip())
        if not m or not m[1].startswith("CEF:"):
            raise ValueError("not a CEF line")
        head = [re.sub(r"\\(.)", r"\1", g) for g in m.groups()[:7]]
        head[0] = head[0][4:]
        out: dict = dict(zip(CEF_HEADER, head))
        out["version"], out["severity"] = maybe_int(out["version"]), maybe_int(out["severity"])
        labels, at, rest = {}, 0, m[8]
        while pair := CEF_PAIR.match(rest, at):
            key, value = pair[1].strip(), (pair[2] if pair[2] is not None else pair[3] or "").strip() if pair[2] is None else pair[2]
            out[key] = value
            if key.endswith("Label") and value:
                labels[key[:-5]] = value
            if pair.end() == at:
                break
            at = pair.end()
        return out | {label: out[base] for base, label in labels.items() if base in out}


# --- Windows events -----------------------------------------------------------------------------

def indent_of(line: str) -> int:
    """Width of the white space before the text, tabs to stops of eight."""
    wide = line.expandtabs(8)
    return len(wide) - len(wide.lstrip())


def split_pair(line: str) -> tuple[str, str, int] | None:
    """Name, value and the column of the value of a line ``name: value`` or ``name=value``; the value of a section's heading is empty.

    A name is made of words, points, hyphens and brackets and begins with a letter or digit.
    """
    cut = min((i for i in (line.find(":"), line.find("=")) if i >= 0), default=-1)
    name = line[:cut].strip() if cut > 0 else ""
    if not name or not name[0].isalnum() or not all(c.isalnum() or c in " _.-()" for c in name):
        return None
    value = line[cut + 1 :].strip()
    if line[cut] == "=" and not value:
        return None
    return name, value, indent_of(" " * len(line[: cut + 1].expandtabs(8)) + line[cut + 1 :])


PROSE, MARKUP = ("Description", "description"), "Event Xml"


class WindowsRule(Rule):
    """``windows_multiline``: pairs, sections of indented pairs, free text, event XML and values over several lines.

    Where a line belongs is told by its depth alone: a line without a pair that begins at least as deep as the
    last value's column (and deeper than that value's name) continues the value; an indented pair belongs to the
    open section; anything else is free text under the last free-text heading, or under ``description``.
    """

    def __init__(self, config: dict):
        self.where = config.get("timestampLocationType", "NO_TIMESTAMP")
        self.field = (config.get("config") or {}).get("target_field")
        if self.where == "FROM_FIELD" and not self.field:
            raise ExpressionError("windows_multiline: FROM_FIELD needs config.target_field")

    def read(self, text):
        root: dict = {}
        section: dict | None = None
        heading = None  # of the free text
        free: dict[str, list[str]] = {}
        last: tuple[dict, str, int] | None = None  # holder, name and column of the value that may go on
        lines = text.splitlines()
        for line in lines:
            if not line.strip():
                if heading is None:
                    last = None
                continue
            depth = indent_of(line)
            if heading == MARKUP and line.lstrip().startswith("<"):
                free[heading].append(line)
                continue
            pair = split_pair(line)
            if last and pair is None and depth > 0 and depth >= last[2]:
                last[0][last[1]] += "\n" + line.strip()
                continue
            if pair is None:
                if root or free:
                    section, last, heading = None, None, heading or "description"
                    free.setdefault(heading, []).append(line)
                continue
            name, value, column = pair
            heading = None
            if not value:
                last = section = None
                if name in PROSE or name == MARKUP:
                    heading = name
                    free.setdefault(name, [])
                else:
                    section = root[name] = {}
                continue
            if depth == 0:
                section = None
            holder = root if section is None else section
            holder[name] = value
            last = (holder, name, column)
        for name, found in free.items():
            if found:
                body = "\n".join(found).strip()
                root[name] = f"{root[name]}\n{body}" if isinstance(root.get(name), str) and root[name] and name != MARKUP else body
        root["__raw__"] = text
        stamp = (lines or [None])[0] if self.where == "FIRST_LINE" else root.get(self.field) if self.where == "FROM_FIELD" else None
        return root | ({"__ts__": stamp} if isinstance(stamp, str) else {})


RULES = {"grok": GrokRule, "json": JsonRule, "delimited_text": DelimitedRule, "panw_traffic": TrafficRule, "kv_pair": KvRule, "kv_pairs": KvRule, "syslog": SyslogRule, "cef": CefRule, "windows_multiline": WindowsRule}


def rule_of(config: dict) -> Rule:
    kind = config.get("type")
    if kind not in RULES:
        raise ExpressionError(f"unknown extraction rule {kind!r}")
    return RULES[kind](config)
