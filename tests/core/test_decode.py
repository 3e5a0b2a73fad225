"""The decoder on synthesised files: goldens by shape, recovery, templates, the data source."""

import json
import struct
from datetime import datetime

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from eventlake.binxml import values as V
from eventlake.binxml.reader import CHUNK, Chunk, Settings, decode_chunk, iterate_chunks, system_columns
from eventlake.binxml.render import escape_json, single_keys, to_json, to_xml
from eventlake.binxml.tree import Element, Entity, Instruction, expanded
from eventlake.binxml.values import DecodeError, Value
from eventlake.encoder import PI, ChunkWriter, E, Raw, Ref, Sub, Template, Tokens, event_template, event_values, executable, file_bytes, inline_name, write_records
from eventlake.operators.filters import Filters, parse_ranges
from eventlake.sources import winlog
from eventlake.templates import cache, manifest, pe, render

T0 = datetime(2016, 7, 8, 18, 12, 51, 681640)
G = "54849625-5478-4994-A5BA-3E3B0328C30D"


def decode(root, values=(), **settings):
    """(xml, json text) of a record of one template instance."""
    w = ChunkWriter()
    assert w.add(1, T0, Template(G, root), list(values))
    both = [next(decode_chunk(w.finish(), Settings(**settings), xml=True, programs=p)) for p in (False, True)]
    assert both[0] == both[1] and not both[0].get("error"), both
    return both[0]["xml"], both[0]["Raw"]


def data_of(children, values=(), **settings):
    return json.loads(decode(E("Event", [], [E("EventData", [], children)]), values, **settings)[1])["Event"]["EventData"]


def security_event(**more):
    t = event_template([], G)
    return t, event_values(provider="Microsoft-Windows-Security-Auditing", event_id=4608, level=0, task=12288, keywords=0x8020000000000000, time=T0, record_id=1, channel="Security", computer="37L4247F27-25", **more)


def test_event_as_xml():
    t, v = security_event()
    xml, _ = decode(t.root, v)
    lines = xml.split("\n")
    assert lines[:5] == ['<?xml version="1.0" encoding="utf-8"?>', '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event">', "  <System>", '    <Provider Name="Microsoft-Windows-Security-Auditing">', "    </Provider>"]
    assert "    <Keywords>0x8020000000000000</Keywords>" in lines
    assert '    <TimeCreated SystemTime="2016-07-08T18:12:51.681640Z">' in lines
    assert lines[-8:] == ["    <Computer>37L4247F27-25</Computer>", "    <Security>", "    </Security>", "  </System>", "  <EventData>", "  </EventData>", "</Event>", ""]
    flat, _ = decode(t.root, v, indent=False)
    assert flat.count("\n") == 1 and "<Security></Security></System><EventData></EventData></Event>" in flat


def test_event_as_json_in_both_layouts():
    t, v = security_event(user="S-1-5-21-1223297778-3299746493-1462173606-500")
    system = json.loads(decode(t.root, v, separate_attributes=False)[1])["Event"]["System"]
    assert system["Provider"] == {"#attributes": {"Name": "Microsoft-Windows-Security-Auditing"}}
    assert system["EventID"] == 4608 and system["Security"] == {"#attributes": {"UserID": "S-1-5-21-1223297778-3299746493-1462173606-500"}}
    apart = json.loads(decode(t.root, v)[1])
    assert apart["Event_attributes"] == {"xmlns": "http://schemas.microsoft.com/win/2004/08/events/event"}
    assert apart["Event"]["System"]["Provider_attributes"] == {"Name": "Microsoft-Windows-Security-Auditing"}
    assert "Provider" not in apart["Event"]["System"] and "Security" not in apart["Event"]["System"]


def test_named_data_and_empty_strings():
    fields = [E("Data", [("Name", n)], [Sub(i, k)]) for i, (n, k) in enumerate([("A", V.STRING), ("B", V.HEX64), ("C", V.SID), ("D", V.UINT32)])] + [E("Data", [], ["unnamed is skipped"])]
    got = data_of(fields, [(V.STRING, ""), (V.HEX64, 0x3E7), (V.SID, "S-1-5-18"), (V.UINT32, 7)])
    assert got == {"A": "", "B": "0x3e7", "C": "S-1-5-18", "D": 7}


def test_positional_data_and_binary():
    t = [E("Data", [], [Sub(0, V.STRING | V.ARRAY)]), E("Binary", [], [Sub(1, V.BINARY)])]
    items = ["10.00.", "15063", "", "Multiprocessor Free", "0"]
    assert data_of(t, [(V.STRING | V.ARRAY, items), (V.NULL, None)]) == {"Data": {"#text": items}, "Binary": None}
    assert data_of(t, [(V.STRING | V.ARRAY, ["one"]), (V.BINARY, b"\x0a\xff")]) == {"Data": {"#text": "one"}, "Binary": "0AFF"}
    xml, _ = decode(E("Event", [], [E("EventData", [], t)]), [(V.STRING | V.ARRAY, ["a", ""]), (V.NULL, None)])
    assert "    <Data>a</Data>\n    <Data>\n    </Data>\n    <Binary></Binary>\n" in xml


def test_repeated_names_get_suffixes():
    root = E("Event", [], [E("UserData", [], [E("X", [], [E("H", [], ["1"]), E("H", [("a", "b")], ["2"]), E("H", [("a", "c")])])])])
    assert json.loads(decode(root)[1])["Event"]["UserData"]["X"] == {"H": "1", "H_1_attributes": {"a": "b"}, "H_1": "2", "H_2_attributes": {"a": "c"}}
    assert json.loads(decode(root, separate_attributes=False)[1])["Event"]["UserData"]["X"] == {"H": "1", "H_1": {"#attributes": {"a": "b"}, "#text": "2"}, "H_2": {"#attributes": {"a": "c"}}}


def test_repeated_data_names_keep_the_last():
    fields = [E("Data", [("Name", "P")], ["1"]), E("Data", [("Name", "Q")], ["x"]), E("Data", [("Name", "P")], ["2"])]
    assert decode(E("Event", [], [E("EventData", [], fields)]))[1].endswith('"EventData":{"P":"2","Q":"x"}}}')
    assert single_keys('{"a":1,"b":{"c":1,"c":2}}') == '{"a":1,"b":{"c":2}}'


def test_entities_instructions_and_escapes():
    root = E("Event", [], [E("A", [("q", 'x"<&')], ["say ", Ref("quot"), "hi", Ref("quot"), Ref("other"), " <&>'"]), E("B", [], [PI("target", "data")])])
    xml, text = decode(root)
    assert '<A q="x&quot;&lt;&amp;">say &quot;hi&quot;&other; &lt;&amp;&gt;\'</A>' in xml and "<B><?target data?></B>" in xml
    assert json.loads(text)["Event"]["A"] == "say \"hi\"&other; <&>'" and json.loads(text)["Event"]["B"] is None
    assert escape_json('a"\\\n\x1f\ud800b') == 'a\\"\\\\\\n\\u001Fb'


def test_nested_fragment_and_arrays():
    w = ChunkWriter()
    # The fragment's names are inlined where they stand, so its place has to be known: it's the record's last value.
    t = Template(G, E("Event", [], [E("UserData", [], [Sub(0, V.BINXML)])]))
    probe = w.instance(512 + 28, t, [(V.BINXML, b"")], {}, {})
    inner = Tokens(512 + 28 + len(probe), dict(ChunkWriter().names), template=False).fragment(E("In", [], ["side"]))
    assert w.add(1, T0, t, [(V.BINXML, inner)])
    row = next(decode_chunk(w.finish(), xml=True))
    assert json.loads(row["Raw"])["Event"]["UserData"] == {"In": "side"}
    two = E("D", [("a", Sub(1, V.INT32 | V.ARRAY))], [Sub(0, V.STRING | V.ARRAY)])
    xml, _ = decode(E("Event", [], [two]), [(V.STRING | V.ARRAY, ["x", "y"]), (V.INT32 | V.ARRAY, [1, 2, 3])])
    assert [line.strip() for line in xml.split("\n")[2:8]] == [f'<D a="{n}">{s}</D>' for s in "xy" for n in (1, 2, 3)]
    assert len(expanded(Element("D", [], [Value(V.INT32 | V.ARRAY, [1])]))) == 1


@pytest.mark.parametrize(
    ("kind", "value", "text"),
    [
        (V.INT8, -5, "-5"), (V.UINT64, 2**64 - 1, str(2**64 - 1)), (V.REAL64, 1.5, "1.5"), (V.REAL32, 0.1, "0.1"), (V.BOOL, 7, "true"), (V.GUID, G, G), (V.SIZET, 255, "0xff"), (V.HEX32, 0, "0x0"),
        (V.FILETIME, 0, "1601-01-01T00:00:00.000000Z"), (V.SYSTIME, (2020, 2, 0, 29, 1, 2, 3, 4), "2020-02-29T01:02:03.004000Z"), (V.SYSTIME, (0,) * 8, "1601-01-01T00:00:00.000000Z"), (V.ANSI, "é", "é"),
        (V.UINT16 | V.ARRAY, [1, 2], None), (V.GUID | V.ARRAY, [G, G], None), (V.BOOL | V.ARRAY, [1, 0], None),
    ],
)
def test_value_types(kind, value, text):
    xml, _ = decode(E("Event", [], [E("V", [], [Sub(0, kind)])]), [(kind, value)])
    if text is None:
        assert xml.count("<V>") == 2
    else:
        assert f"<V>{text}</V>" in xml


@pytest.mark.parametrize(
    ("values", "code"),
    [([(V.HANDLE, b"\0" * 8)], "Unimplemented"), ([(V.STRING, b"abc")], "InvalidData"), ([(V.SYSTIME, (2020, 13, 0, 1, 0, 0, 0, 0))], "InvalidTime"), ([(V.SIZET, b"abc")], "Unimplemented"), ([(V.UINT16 | V.ARRAY, b"abc")], "InvalidData"), ([(0x77, b"")], "InvalidValueVariant")],
)
def test_bad_values_are_error_rows(values, code):
    w = ChunkWriter()
    t = Template(G, E("Event", [], [Sub(0)]))
    w.add(1, T0, t, values)
    w.add(2, T0, t, [(V.STRING, "fine")])
    rows = list(decode_chunk(w.finish()))
    assert [r.get("error", {}).get("code") for r in rows] == [code, None]


def chunk(n=3, first=1, **finish):
    w = ChunkWriter()
    t, _ = security_event()
    for i in range(first, first + n):
        assert w.add(i, T0, t, event_values(provider="P", event_id=i, level=4, task=0, keywords=0, time=T0, record_id=i, channel="C", computer="H"))
    return w.finish(**finish)


def ids(data, **settings):
    return [r["error"]["code"] if r.get("error") else r["record_id"] for r in decode_chunk(data, Settings(**settings))]


def test_recovery_rules():
    good = chunk()
    assert ids(good) == [1, 2, 3]
    second = struct.unpack_from("<I", good, 516)[0] + 512
    assert ids(b"X" + good[1:]) == ["InvalidChunkMagic"]
    assert ids(good[:second] + b"\0\0\0\0" + good[second + 4 :]) == [1]
    assert ids(good[:second] + b"zzzz" + good[second + 4 :]) == [1, "InvalidRecordMagic"]
    assert ids(good[: second + 4] + struct.pack("<I", 0) + good[second + 8 :]) == [1, "InvalidRecordSize"]
    assert ids(good[: second + 4] + struct.pack("<I", 1 << 20) + good[second + 8 :]) == [1, "Truncated"]
    assert ids(chunk(free_space_offset=1 << 30)) == [1, 2, 3]
    assert ids(chunk(last_record_id=2)) == [1, 2]
    bad = chunk(events_crc=1)
    assert ids(bad) == [1, 2, 3] and ids(bad, validate_checksums=True) == ["ChecksumMismatch"]
    assert ids(chunk(events_crc=1, flags=4), validate_checksums=True) == [1, 2, 3]
    assert Chunk(good).checksums() == (True, True)


def test_odd_fragments():
    w = ChunkWriter()
    w.add(1, T0, None, b"\x0f\x01\x01\x00\x00")
    w.add(2, T0, None, b"\x0f\x01\x01\x00\x07")
    w.add(3, T0, None, b"\x0f\x01\x01\x00\x04")
    rows = list(decode_chunk(w.finish(), xml=True))
    assert rows[0]["xml"].endswith("<Event>\n</Event>\n") and json.loads(rows[0]["Raw"]) == {"Event": None}
    assert [r["error"]["code"] for r in rows[1:]] == ["UnimplementedToken", "Tree"]


def test_depth_is_bounded():
    deep = E("A", [], ["x"])
    for _ in range(600):
        deep = E("A", [], [deep])
    w = ChunkWriter()
    w.add(1, T0, None, Tokens(512 + 24, {}, template=False).fragment(deep))
    assert [r["error"]["code"] for r in decode_chunk(w.finish())] == ["TooDeep"]


def test_files_with_zero_chunks_and_wrong_counts():
    data = file_bytes([chunk(2, 1), b"\0" * CHUNK, chunk(2, 3), chunk(1, 5)], chunk_count=1)
    assert [n for n, _ in iterate_chunks(lambda at, k: data[at : at + k], len(data))] == [0, 2, 3]
    with pytest.raises(DecodeError):
        list(iterate_chunks(lambda at, k: b"short"[at : at + k], 5))


def test_viewer_columns():
    at = lambda **system: system_columns({"Event": {"System": system}})
    assert at(EventID="12", Level="3", Provider={"Name": "N"}, Channel=5) == {"EventID": 12, "Level": 4, "Provider": "N", "Channel": ""}
    assert at(EventID={"#text": "7"}, Level=2, Provider_attributes={"Name": "A"}, Channel="C") == {"EventID": 7, "Level": 2, "Provider": "A", "Channel": "C"}
    assert at(EventID={"#text": 7})["EventID"] is None and at(EventID=2**32 + 1)["EventID"] == 1 and at(EventID="x")["EventID"] is None


@given(st.binary(max_size=400))
def test_any_bytes_give_rows_not_exceptions(noise):
    good = chunk(1)
    rows = list(decode_chunk((good[:560] + noise).ljust(CHUNK, b"\0")[:CHUNK], xml=True))
    assert all("error" in r or "Raw" in r for r in rows)


TEXT = st.text(st.characters(codec="utf-16-le", exclude_characters="\0"), max_size=12)
SLOT = st.one_of(
    TEXT.map(lambda s: (V.STRING, s)),
    st.integers(0, 2**32 - 1).map(lambda n: (V.UINT32, n)),
    st.booleans().map(lambda b: (V.BOOL, b)),
    st.just((V.NULL, None)),
    st.floats(allow_nan=False, width=64).map(lambda x: (V.REAL64, x)),
    st.binary(max_size=5).map(lambda b: (V.BINARY, b)),
    st.lists(TEXT, max_size=3).map(lambda x: (V.STRING | V.ARRAY, x)),
    st.lists(st.integers(0, 99), max_size=3).map(lambda x: (V.UINT16 | V.ARRAY, x)),
)


@given(st.lists(st.tuples(SLOT, SLOT, SLOT, SLOT), min_size=1, max_size=6), st.booleans(), st.booleans())
def test_programs_equal_the_plain_way(records, separate, indent):
    root = E("Event", [("a", Sub(0))], [E("S", [("b", ["x", Sub(1)]), ("c", Sub(2, optional=False))], [Sub(3)]), E("M", [], ["t", Sub(0), Sub(1)]), E("EventData", [], [E("Data", [("Name", Sub(2))], [Sub(3)]), E("Data", [], [Sub(1, optional=False)]), E("Binary", [], [Sub(0)])])])
    w = ChunkWriter()
    for i, values in enumerate(records):
        assert w.add(i + 1, T0, Template(G, root), list(values))
    data, settings = w.finish(), Settings(separate_attributes=separate, indent=indent)
    assert list(decode_chunk(data, settings, xml=True)) == list(decode_chunk(data, settings, xml=True, programs=False))


COLUMN = st.one_of(
    SLOT,
    st.sampled_from(["12", "+7", "-3", "99999999999", "4x", ""]).map(lambda s: (V.STRING, s)),
    st.integers(-(2**63), 2**63 - 1).map(lambda n: (V.INT64, n)),
    st.integers(0, 255).map(lambda n: (V.UINT8, n)),
    st.integers(0, 2**64 - 1).map(lambda n: (V.HEX64, n)),
    st.integers(0, 2**63).map(lambda n: (V.FILETIME, n)),
    st.just((V.GUID, G)),
    st.just((V.SID, "S-1-5-18")),
)


@given(st.lists(st.tuples(COLUMN, COLUMN, COLUMN, COLUMN), min_size=1, max_size=6), st.booleans(), st.sampled_from(["", "x"]))
def test_quick_columns_equal_the_plain_way(records, separate, fixed):
    system = E("System", [], [E("Provider", [("Name", [fixed, Sub(0)] if fixed else Sub(0))]), E("EventID", [("Qualifiers", Sub(2))], [Sub(1)]), E("Level", [], [Sub(2)]), E("Channel", [], [Sub(3)]), *([E("Computer", [], [fixed])] if fixed else [])])
    w = ChunkWriter()
    for i, values in enumerate([*records, *records]):  # each shape comes again, so its program is known
        assert w.add(i + 1, T0, Template(G, E("Event", [], [system])), list(values))
    data, settings = w.finish(), Settings(separate_attributes=separate)
    assert list(decode_chunk(data, settings, xml=True)) == list(decode_chunk(data, settings, xml=True, programs=False))


@pytest.mark.parametrize("separate", [False, True])
def test_event_id_with_qualifiers_is_the_same_by_all_ways(separate):
    """A number beside attributes: joined with them it's an object, apart it's a number."""
    system = E("System", [], [E("Provider", [("Name", "p")]), E("EventID", [("Qualifiers", Sub(0, V.UINT16))], [Sub(1, V.UINT16)]), E("Level", [], [Sub(2, V.UINT8)])])
    w, t = ChunkWriter(), Template(G, E("Event", [], [system]))
    for i in range(6):
        assert w.add(i, T0, t, [(V.UINT16, 7), (V.UINT16, 4600 + i), (V.UINT8, 2)])
    data, settings = w.finish(), Settings(separate_attributes=separate)
    want = [r["EventID"] for r in decode_chunk(data, settings, programs=False)]
    assert want == ([4600 + i for i in range(6)] if separate else [None] * 6)
    assert [r["EventID"] for r in decode_chunk(data, settings)] == want
    assert all(b.column("EventID").to_pylist() == want for b in _blocks([(0, data)], settings=settings)[1])


# The data source


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    t, _ = security_event()
    for f in range(2):
        rows = [(i, T0, t, event_values(provider="P", event_id=i % 7, level=4, task=0, keywords=0, time=T0, record_id=i, channel="C", computer="H")) for i in range(1 + 1000 * f, 1001 + 1000 * f)]
        (folder / f"log{f}.evtx").write_bytes(file_bytes(write_records(rows)))
    (folder / "bad.evtx").write_bytes(b"nothing")
    (folder / "note.txt").write_bytes(b"text")
    (folder / "more").mkdir()
    (folder / "more" / "log9.evtx").write_bytes(file_bytes([chunk(3, 9001)]))
    return folder


def test_source_views_and_modes(spark, logs):
    rows = winlog.read(spark, str(logs), extensions="evtx", chunksPerPartition=1)
    assert rows.where("error IS NULL").count() == 2000 and rows.where("error IS NOT NULL").count() == 1
    assert rows.rdd.getNumPartitions() > 3
    assert winlog.read(spark, str(logs), extensions="evtx", recursive=True, mode="dropmalformed").count() == 2003
    with pytest.raises(Exception, match="no header"):
        winlog.read(spark, str(logs), extensions="evtx", mode="failfast").count()
    chunks = winlog.read(spark, str(logs / "log0.evtx"), view="chunks", chunksPerPartition=1).orderBy("chunk_no").collect()
    assert sum(c["record_count"] for c in chunks) == 1000 and [c["chunk_ordinal"] for c in chunks] == list(range(len(chunks))) and all(c["header_ok"] and c["events_ok"] for c in chunks)
    assert winlog.read(spark, str(logs / "log0.evtx"), view="record_headers").count() == 1000
    assert winlog.read(spark, str(logs / "log0.evtx"), view="files").first()["major"] == 3
    one = winlog.read(spark, str(logs / "log0.evtx"), view="template_instances").where("record_id = 5").first()
    assert one["guid"] == G and one["substitutions"][1]["text"] == "5"
    with pytest.raises(Exception, match="view is one of"):
        winlog.read(spark, str(logs), view="nothing").count()


def test_record_id_prunes_chunks(spark, logs):
    rows = winlog.read(spark, f"{logs / 'log0.evtx'},{logs / 'log1.evtx'}")
    assert [r["record_id"] for r in rows.where("record_id = 1500").collect()] == [1500]
    assert rows.where("record_id BETWEEN 10 AND 19").count() == 10
    assert rows.where("record_id IN (3, 1999, 5000)").count() == 2
    assert rows.where("record_id = 3 AND record_id IN (4)").count() == 0
    asked = winlog.read(spark, f"{logs / 'log0.evtx'},{logs / 'log1.evtx'}", recordIds="3,1990-2010")
    assert sorted(r["record_id"] for r in asked.collect()) == [3, *range(1990, 2001)]
    assert sorted(r["record_id"] for r in rows.where("record_id = 7").union(rows.where("record_id = 1500")).collect()) == [7, 1500]


def test_streaming_ingest(spark, logs, tmp_path):
    from eventlake.streaming.ingest import ingest, live_counts, stream_files

    def run():
        q = ingest(stream_files(spark, str(logs), pattern="log*.evtx", mode="dropmalformed"), str(tmp_path / "t"), str(tmp_path / "c"))
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "t")).count()

    assert run() == 2000
    assert run() == 2000  # nothing new
    q = live_counts(stream_files(spark, str(logs), pattern="log*.evtx")).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["cnt"] for r in spark.table("live").collect()] == [2000]


def test_command_line(logs, tmp_path, capsys):
    from eventlake import cli

    out = tmp_path / "o.jsonl"
    assert cli.main(["dump", str(logs / "log0.evtx"), "-o", "jsonl", "-f", str(out), "--events", "2-3,7"]) == 0
    assert [json.loads(x)["Event"]["System"]["EventRecordID"] for x in out.read_text().splitlines()] == [2, 3, 7]
    with pytest.raises(SystemExit):
        cli.main(["dump", str(logs / "log0.evtx"), "-f", str(tmp_path)])
    with pytest.raises(SystemExit):
        cli.main(["dump", str(logs / "log0.evtx"), "-f", str(out)])


def test_filter_state():
    f = Filters().toggle("level", 2).toggle("level", 3).toggle("event_data", "x", "k")
    assert f.level == (2, 3) and f.toggle("level", 2).level == (3,) and f.toggle("event_data", "x", "k").event_data == {}
    assert f.describe() == ["level: 2", "level: 3", "k: x"] and f.clear() == Filters()
    assert parse_ranges("1-5,9") == [(1, 5), (9, 9)]
    for bad in ("", "a", "1-", "1-2-3"):
        with pytest.raises(ValueError):
            parse_ranges(bad)


# Provider templates


def text_block(s):
    raw = s.encode("utf-16-le") + b"\0\0"
    return struct.pack("<I", 4 + len(raw)) + raw


PROVIDER = "11111111-2222-3333-4444-555555555555"


def crim(root=None, *, template=G, event_id=42):
    """A manifest with one provider: a channel, a level, one template of one item, one event, one value map."""
    from eventlake.encoder import guid

    body = Tokens(0, None, template=True).fragment(root or E("EventData", [], [E("Data", [("Name", "Who")], [Sub(0, V.STRING)])]))
    out = bytearray(b"CRIM" + struct.pack("<IHHI", 0, 3, 1, 1) + guid(PROVIDER) + struct.pack("<I", 36))
    sections = [b"CHAN", b"LEVL", b"TTBL", b"EVNT", b"MAPS"]
    head = len(out)
    out += b"WEVT" + struct.pack("<IIII", 0, 0xFFFFFFFF, len(sections), 0) + b"\0" * 8 * len(sections)
    places = []

    def put(block):
        places.append(len(out))
        out.extend(block)

    here = len(out)
    put(b"CHAN" + struct.pack("<II", 28, 1) + struct.pack("<IIII", 16, here + 28, 0, 7))
    out.extend(text_block("Security"))
    here = len(out)
    put(b"LEVL" + struct.pack("<II", 24, 1) + struct.pack("<III", 4, 0xFFFFFFFF, here + 24))
    out.extend(text_block("Info"))
    here = len(out)
    temp = here + 12
    items = temp + 40 + len(body)
    name = text_block("Who")
    size = 40 + len(body) + 20 + len(name)
    put(b"TTBL" + struct.pack("<II", 12 + size, 1) + b"TEMP" + struct.pack("<IIIII", size, 1, 1, items, 1) + guid(template) + body + struct.pack("<IBBHIHHI", 0, 1, 1, 0, 0, 1, 0, items + 20) + name)
    put(b"EVNT" + struct.pack("<III", 64, 1, 0) + struct.pack("<HBBBBHQIIIIIIII", event_id, 1, 16, 4, 0, 3, 1 << 63, 9, temp, 0, 0, 0, 0, 0, 0))
    here = len(out)
    put(b"MAPS" + struct.pack("<III", 16 + 24, 1, 0) + b"VMAP" + struct.pack("<III", 24, 0, 1) + struct.pack("<II", 5, 0xFFFFFFFF))
    struct.pack_into("<I", out, 4, len(out))
    for i, p in enumerate(places):
        struct.pack_into("<I", out, head + 20 + 8 * i, p)
    return bytes(out)


def test_manifest_and_resources():
    blob = crim()
    p = manifest.parse(blob)["providers"][0]
    assert p["guid"] == PROVIDER and p["message_id"] is None
    assert p["channels"][0]["name"] == "Security" and p["levels"][0]["name"] == "Info" and p["levels"][0]["message_id"] is None
    assert p["templates"][0]["guid"] == G and p["templates"][0]["items"][0]["name"] == "Who"
    assert p["events"][0]["identifier"] == 42 and p["events"][0]["template_offset"] == p["templates"][0]["offset"]
    assert p["maps"][0]["entries"] == [{"identifier": 5, "message_id": None}]
    assert list(pe.resources(executable(blob))) == [("1", 1033, blob)]


@pytest.mark.parametrize(("at", "new", "code"), [(0, b"XXXX", "InvalidSignature"), (4, b"\xff\xff\xff\xff", "SizeOutOfBounds"), (4, b"\x01\0\0\0", "SizeOutOfBounds"), (12, b"\xff\xff\0\0", "Truncated"), (36, b"XXXX", "InvalidSignature"), (48, b"\xff\xff\0\0", "Truncated")])
def test_damaged_manifests(at, new, code):
    blob = crim()
    with pytest.raises(DecodeError) as e:
        manifest.parse(blob[:at] + new + blob[at + len(new) :])
    assert e.value.code == code


def test_cache_render_and_fallback(tmp_path, spark):
    data = cache.write([crim(), crim(template=G, event_id=43)])
    (tmp_path / "t.wevtcache").write_bytes(data)
    known = cache.TemplateCache(cache.read(data))
    assert known.resolve("{" + PROVIDER.upper() + "}", 42, 1) == G.lower() and known.resolve(PROVIDER, 1, 1) is None
    body = known.body(" {" + G + "} ")
    assert render.with_placeholders(body, ["Who"], indent=False) == '<EventData><Data Name="Who">{sub:0:Who}</Data></EventData>'
    assert render.with_placeholders(body, indent=False) == '<EventData><Data Name="Who">{sub:0}</Data></EventData>'
    assert render.with_values(body, render.json_values(["<me>"]), indent=False) == '<EventData><Data Name="Who">&lt;me&gt;</Data></EventData>'
    with pytest.raises(DecodeError):
        list(cache.read(b"WEVTCACX" + data[8:]))
    # A record whose own template is damaged.
    w = ChunkWriter()
    w.add(1, T0, Template(G, E("EventData", [], [E("Data", [], [Sub(0)])])), [(V.STRING, "you")])
    broken = bytearray(w.finish())
    at = 512 + 28 + 10 + 24
    broken[at + 4] = 0x77
    assert next(decode_chunk(bytes(broken)))["error"]["code"] == "InvalidToken"
    fixed = next(decode_chunk(bytes(broken), Settings(offline=known.body)))
    assert "you" in fixed["Raw"]
    (tmp_path / "x.evtx").write_bytes(file_bytes([bytes(broken)]))
    rows = winlog.read(spark, str(tmp_path / "x.evtx"), templateCache=str(tmp_path / "t.wevtcache")).collect()
    assert rows[0]["error"] is None and "you" in rows[0]["Raw"]


def test_manifest_relations(spark, tmp_path):
    (tmp_path / "a.dll").write_bytes(executable(crim()))
    (tmp_path / "b.dll").write_bytes(b"MZ")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = manifest.manifests(files).persist()
    assert found.where("error IS NOT NULL").count() == 1
    assert manifest.stats(found).select("providers", "templates", "events", "maps", "channels", "levels", "opcodes", "tasks", "keywords").collect() == [(1, 1, 1, 1, 1, 1, 0, 0, 0)]
    assert [tuple(r) for r in manifest.event_templates(found).select("identifier", "template_guid").collect()] == [(42, G)]
    assert manifest.event_index(found).first()["template_guids"] == [G]
    found.unpersist()


def test_inline_names_check_their_hash():
    from eventlake.binxml.tree import inline_name as read_name

    assert read_name(inline_name("Größe"), 0) == ("Größe", len(inline_name("Größe")))
    with pytest.raises(DecodeError):
        read_name(b"\0\0" + inline_name("Data")[2:], 0)


def test_xml_of_a_plain_tree():
    tree = Element("A", [("x", [Entity("amp")]), ("gone", [""])], [Element("B", [], [Instruction("t")]), "tail"])
    assert to_xml(tree, declaration=False) == '<A x="&amp;">\n  <B><?t?></B>\n  tail\n</A>\n'
    assert to_json(tree) == '{"A":{"#attributes":{"x":"&"},"#text":"tail","B":null}}'


def _blocks(chunks, **more):
    from pyspark.sql.pandas.types import to_arrow_schema

    from eventlake import schema
    from eventlake.binxml.columnar import BlockDecoder
    from eventlake.binxml.reader import Settings

    arrow = to_arrow_schema(schema.RECORDS)
    decoder = BlockDecoder(arrow, more.pop("settings", Settings()), **{"json": True, "xml": False} | more)
    plain, asked = decoder._plain, []
    decoder._plain = lambda *a: asked.append(1) or plain(*a)
    # Twice, so that templates are known from the first block on.
    made = [decoder.decode("f", chunks) for _ in range(2)]
    return arrow, made, len(asked) / max(1, sum(b.num_rows for b in made))


GUID_PAIR = (G, G[:-1] + "E")
KINDS = [V.STRING, V.INT8, V.UINT8, V.INT16, V.UINT16, V.INT32, V.UINT32, V.INT64, V.UINT64, V.BOOL, V.GUID, V.FILETIME, V.SID, V.HEX32, V.HEX64, V.NULL, V.REAL64, V.ANSI, V.BINARY, V.STRING | V.ARRAY]


def _random_values(rng):
    text = lambda: "".join(rng.choice(list("ab \"\\<>&'\n\té漢😀\0")) for _ in range(rng.randrange(6)))
    make = {V.STRING: text, V.ANSI: lambda: "aé", V.BOOL: lambda: rng.randrange(3), V.GUID: lambda: "0B5C5F1A-30D4-4F1C-9C1E-7A4F5B2D9E10", V.SID: lambda: f"S-1-5-21-{rng.randrange(99)}-500", V.FILETIME: lambda: datetime(2000 + rng.randrange(90), 1, 2, 3, 4, 5, rng.randrange(10**6)), V.NULL: lambda: None, V.REAL64: lambda: rng.random(), V.BINARY: lambda: b"\1\2"}
    out = []
    for kind in KINDS:
        now = V.NULL if rng.random() < 0.1 else kind
        if now in make:
            out.append((now, make[now]()))
        elif now == V.STRING | V.ARRAY:
            out.append((now, ["x"] * rng.randrange(3)))
        else:
            bits = {V.INT8: 8, V.UINT8: 8, V.INT16: 16, V.UINT16: 16, V.INT32: 32, V.UINT32: 32, V.INT64: 64, V.UINT64: 64, V.HEX32: 32, V.HEX64: 64}[now]
            signed = now in (V.INT8, V.INT16, V.INT32, V.INT64)
            out.append((now, rng.randrange(-(1 << bits - 1), 1 << bits - 1) if signed else rng.randrange(1 << bits)))
    return out


@pytest.mark.parametrize("skip", [(), (V.REAL64, V.ANSI, V.BINARY, V.STRING | V.ARRAY)])
@pytest.mark.parametrize("form", [{}, {"xml": True, "json": False}, {"xml": True}, {"settings": "joined"}])
def test_columns_give_the_rows_of_the_plain_way(form, skip):
    """Random values of all kinds, several templates, damage, fragments that are no instance."""
    import random

    from eventlake.binxml.reader import Settings

    rng = random.Random(len(str(form)) + len(skip))
    kinds = [k for k in KINDS if k not in skip]
    system = [E("Provider", [("Name", [Sub(0)])]), E("EventID", [], [Sub(4)]), E("Level", [], [Sub(2)]), E("Channel", [], [Sub(0)])]
    data = [E("Data", [("Name", f"d{i}")], [Sub(i, k)]) for i, k in enumerate(kinds)]
    both = [Template(GUID_PAIR[k], E("Event", [], [E("System", [], system), E("EventData", [], [*data, E("Data", [("Name", [Sub(0, optional=True)])], [Sub(3)])][: -1 if k else None])])) for k in range(2)]
    chunks = []
    for n in range(5):
        w = ChunkWriter()
        for i in range(40):
            values = [v for k, v in zip(KINDS, _random_values(rng), strict=True) if k in kinds]
            record = (1000 * n + i, datetime(2024, 1, 1, 1, 1, i), both[rng.randrange(2)], values) if rng.random() < 0.9 else (1000 * n + i, datetime(2024, 1, 1), None, b"\x0f\x01\x01\x00\x77")
            if not w.add(*record):
                break
        made = bytearray(w.finish())
        if n == 2:
            made[512 + 28 + 10 + 24 + 4] = 0x77
        if n == 3:
            made[3000:3400] = bytes(rng.randrange(256) for _ in range(400))
        chunks.append((n + 3, bytes(made)))
    form = {k: Settings(separate_attributes=False, indent=False) if v == "joined" else v for k, v in form.items()}
    arrow, got, plain = _blocks(chunks, **form)
    assert plain < 0.5 if skip else plain > 0.5  # kinds without a column form take the plain way
    want = [{"file": "f", "chunk_no": n, "record_seq": (n << 32) + r.pop("row_in_chunk"), **r} for n, c in chunks for r in decode_chunk(c, programs=False, **form)]
    for batch in got:
        assert batch.schema == arrow
        assert batch.to_pylist() == pa.RecordBatch.from_pylist(want, arrow).to_pylist()


def test_headers_by_columns_are_those_of_the_plain_way():
    """Damage, errors, ids and times beyond their range, checksums."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from eventlake import schema
    from eventlake.binxml.columnar import BlockDecoder

    t = Template(G, E("Event", [], [E("A", [], [Sub(0)])]))

    def made(ids, times=(), **change):
        w = ChunkWriter()
        for k, i in enumerate(ids):
            assert w.add(i, times[k] if k < len(times) else T0, t, [(V.STRING, "x")])
        return bytearray(w.finish(**change))

    chunks = [made(range(5)), made([1, 2**63 + 5, 3], last_record_id=3), made(range(4), [2**62, 2**63 + 1]), made(range(9)), bytearray(b"\1" * CHUNK), made(range(7), events_crc=1), made(range(3), free_space_offset=600), made([]), made(range(6))]
    size = struct.unpack_from("<I", chunks[3], 516)[0]
    chunks[3][512 + 2 * size : 516 + 2 * size] = b"bad!"
    chunks[8][516:520] = struct.pack("<I", 20)
    arrow = to_arrow_schema(schema.HEADERS)
    for checked in (False, True):
        o = winlog.Options(view="record_headers", settings=Settings(validate_checksums=checked))
        numbered = [(2 * n, bytes(c)) for n, c in enumerate(chunks)]
        want = [r for n, c in numbered for r in winlog.rows_of_chunk("f", n, c, o)]
        got = BlockDecoder(arrow, o.settings).headers("f", numbered)
        assert got.to_pylist() == pa.RecordBatch.from_pylist(want, arrow).to_pylist() and len(want) > 10


@pytest.mark.parametrize("x, double, single", [(0.0, "0.0", "0.0"), (-0.0, "-0.0", "-0.0"), (1e15, "1000000000000000.0", "1e15"), (1e16, "1e16", "1e16"), (1.5e-5, "0.000015", "0.000015"), (1.5e-6, "1.5e-6", "0.0000015"), (1.5e-7, "1.5e-7", "1.5e-7"), (-12.25, "-12.25", "-12.25"), (100.0, "100.0", "100.0"), (1e300, "1e300", None), (-1.25e-300, "-1.25e-300", None), (float("nan"), "NaN", "NaN"), (float("-inf"), "-inf", "-inf"), (123456789.0, "123456789.0", "123456790.0")])
def test_real_texts(x, double, single):
    assert V.real_text(x, False) == double
    if single is not None:
        assert V.real_text(struct.unpack("<f", struct.pack("<f", x))[0], True) == single


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_real_texts_read_back(x):
    assert float(V.real_text(x, False)) == x
