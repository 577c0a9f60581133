"""Transports that answer from a script, for the tests of road sources."""

import json


def body(*ways):
    return json.dumps({"elements": [{"type": "way", "id": w, "geometry": [{"lat": 1, "lon": 2}, {"lat": 1, "lon": 3}], "tags": {"highway": "residential"}} for w in ways]})


def by_key(request, server, text, timeout):
    """Tiles whose x is odd are busy on the primary server; boundaries answer with their text."""
    if "text" in request and request.get("min_lat") is None:
        return 200, text
    if int(request["key"].split("/")[1]) % 2 and server == "primary":
        return 504, "busy"
    return 200, body(int(request["key"].split("/")[2]))


def broken(request, server, text, timeout):
    return 400, "no"
