"""Structure of settings files: TOML, YAML, INI and XML."""

from __future__ import annotations

import re
import tomllib
import xml.etree.ElementTree as ET


def _toml_type(v):
    if isinstance(v, dict):
        return {k: _toml_type(x) for k, x in v.items()}
    if isinstance(v, list):
        return {"type": "array", "element": _toml_type(v[0]) if v else "unknown"}
    return {bool: "boolean", int: "integer", float: "float", str: "string"}.get(type(v), "datetime")


def toml_summary(data: bytes) -> dict:
    doc = tomllib.loads(data.decode())
    sections = keys = deepest = 0
    todo = [(doc, 1)]
    while todo:
        t, depth = todo.pop()
        sections += 1
        deepest = max(deepest, depth)
        for v in t.values():
            keys += 1
            todo += [(x, depth + 1) for x in (v if isinstance(v, list) else [v]) if isinstance(x, dict)]
    return {"section_count": sections, "key_count": keys, "max_depth": deepest, "schema": _toml_type(doc)}


def _yaml_type(v):
    if isinstance(v, dict):
        return {str(k): _yaml_type(x) for k, x in v.items()}
    if isinstance(v, list):
        return {"type": "sequence", "element": _yaml_type(v[0]) if v else "unknown"}
    return {bool: "boolean", int: "integer", float: "float", str: "string", type(None): "null"}.get(type(v), "string")


def yaml_summary(data: bytes) -> dict:
    """Keys, mappings, sequences and scalars; the keys themselves count as scalars."""
    import yaml

    doc = yaml.safe_load(data.decode())
    n = {"key_count": 0, "map_count": 0, "sequence_count": 0, "scalar_count": 0}
    deepest = 0
    todo = [(doc, 0)]
    while todo:
        v, depth = todo.pop()
        deepest = max(deepest, depth)
        if isinstance(v, dict):
            n["map_count"] += 1
            n["key_count"] += len(v)
            todo += [(x, depth + 1) for kv in v.items() for x in kv]
        elif isinstance(v, list):
            n["sequence_count"] += 1
            todo += [(x, depth + 1) for x in v]
        else:
            n["scalar_count"] += 1
    return n | {"max_depth": deepest, "schema": _yaml_type(doc)}


def _scalar(v: str) -> str:
    s = v.strip()
    if s.lower() in ("true", "false", "yes", "no", "on", "off"):
        return "boolean"
    if re.fullmatch(r"[+-]?\d+", s):
        return "integer"
    return "float" if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?", s) else "string"


def ini_summary(data: bytes) -> dict:
    """Sections, keys and comments; indented lines go on with the value before them."""
    schema: dict[str, dict[str, str]] = {}
    comments, section, last = 0, "", None
    values: dict[tuple[str, str], str] = {}
    for raw in data.decode().splitlines():
        s = raw.strip()
        if not s:
            continue
        if s[0] in "#;":
            comments += 1
        elif s[0] == "[" and s[-1] == "]":
            section, last = s[1:-1].strip(), None
            schema.setdefault(section, {})
        elif raw[0] in " \t" and last:
            values[last] += "\n" + s
        elif m := re.match(r"([^=:]+?)\s*[=:]\s*(.*)", s):
            last = (section, m[1])
            values[last] = m[2]
    for (sec, key), v in values.items():
        schema.setdefault(sec, {})[key] = _scalar(v)
    named = [s for s in schema if s]
    return {"section_count": len(named), "key_count": len(values), "comment_count": comments, "max_depth": 2 if named else None, "schema": schema}


def xml_summary(data: bytes) -> dict:
    """Elements, attributes, depth and the merged shape of siblings of the same name."""
    elements = attributes = depth = deepest = 0
    spaces = b"xmlns" in data
    root: dict = {"attributes": {}, "children": {}}
    stack = [root]
    for event, e in ET.iterparse(__import__("io").BytesIO(data), ("start", "end")):
        if event == "start":
            elements += 1
            attributes += len(e.attrib)
            depth += 1
            deepest = max(deepest, depth)
            node = stack[-1]["children"].setdefault(e.tag.rsplit("}", 1)[-1], {"attributes": {}, "children": {}})
            node["attributes"] |= {k.rsplit("}", 1)[-1]: _scalar(v) for k, v in e.attrib.items()}
            stack.append(node)
        else:
            depth -= 1
            stack.pop()
            e.clear()
    return {"element_count": elements, "attribute_count": attributes, "max_depth": deepest, "has_namespaces": spaces, "schema": root["children"]}
