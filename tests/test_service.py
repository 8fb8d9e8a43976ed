"""Tables, loads, queries, results and states, through the service and over HTTP."""

import http.client
import json
import os
import threading

import pytest

from marlstone.http import make_server
from marlstone.problems import DecodeError, ProblemsError
from marlstone.queries import col, fn, op, select
from marlstone.service import Service, Settings, Status

COLUMNS = [{"name": "id", "type": "INT64"}, {"name": "name", "type": "VARCHAR"}, {"name": "age", "type": "INT64"}]
CSV = 'id,name,age\n0,  Ann ,24\n1,"Bo, ""B"" ",25\n2,"two\nlines",0x1A\n3,,-1_000\n'


@pytest.fixture
def settings(tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "people.csv").write_text(CSV)
    return Settings(str(tmp_path / "tables"), str(tmp_path / "results"), str(tmp_path / "catalog.json"), str(data))


@pytest.fixture
def service(spark, settings):
    service = Service(spark, settings)
    yield service
    service.stop()


def query(service, definition):
    return service.wait(service.submit({"queryDefinition": definition}))


def rows(service, definition, **options):
    task = query(service, definition)
    assert task.status is Status.COMPLETED, task.problems
    return [r for c in service.result(task.id, options) for r in zip(*c["columns"])]


def load(service, name="t", file="people.csv", header=True, columns=None):
    out = {"sourceFilepath": file, "destinationTableName": name, "doesCsvContainHeader": header}
    return query(service, out | ({} if columns is None else {"destinationColumns": columns}))


def problems(service, task):
    assert task.status is Status.FAILED
    return [(p.error, p.context) for p in service.problems(task.id)]


def everything(name="t", *names):
    return select(*[col(name, c) for c in names or ("id", "name", "age")], order=[(0, True)])


def test_tables(service, spark, settings):
    table = service.create_table({"name": "t", "columns": COLUMNS})
    assert service.list_tables() == [{"tableId": table, "name": "t"}]
    assert service.catalog.by_id(table).schema_json() == {"name": "t", "columns": COLUMNS}
    with pytest.raises(ProblemsError, match="Error validating schema"):
        service.create_table({"name": "t", "columns": []})
    with pytest.raises(ProblemsError, match="Error validating schema"):
        service.create_table({"name": "u", "columns": COLUMNS[:1] * 2})
    with pytest.raises(DecodeError):
        service.create_table({"name": "u", "columns": [{"name": "c", "type": "5"}]})
    assert Service(spark, settings).catalog.by_id(table).name == "t"
    service.catalog.drop(table)
    service.catalog.drop(table)
    assert service.list_tables() == []


def test_empty_catalog_file(spark, settings):
    with open(settings.catalog_path, "w") as file:
        file.write(" \n")
    assert Service(spark, settings).list_tables() == []


def test_load_and_select(service):
    service.create_table({"name": "t", "columns": COLUMNS})
    assert rows(service, everything()) == []
    task = load(service)
    assert service.describe_query(task.id)["isResultAvailable"] is False
    assert service.result(task.id) is None
    wanted = [(0, "Ann", 24), (1, 'Bo, "B" ', 25), (2, "two\nlines", 26), (3, "", -1000)]
    assert rows(service, everything()) == wanted
    first = service.catalog.by_name("t").files
    load(service)
    assert service.catalog.by_name("t").files[1:] == first
    assert len(rows(service, everything())) == 8
    assert rows(service, select(fn("CONCAT", col("t", "name"), "!"), where=op("LESS_THAN", col("t", "id"), 1), limit=1)) == [("Ann!",)]


def test_loads_fail_whole(service, settings):
    service.create_table({"name": "t", "columns": COLUMNS})
    for name, text, error in (("short", "1,a,2\n3,b\n", "Invalid CSV file"), ("long", "1,a,2\n1,a,2,3\n", "Invalid CSV file"), ("word", "1,a,2\nx,b,3\n", "Failed to parse INT64"), ("big", "9223372036854775808,b,3\n", "Failed to parse INT64")):
        with open(os.path.join(settings.data_folder, name), "w") as file:
            file.write(text)
        assert problems(service, load(service, file=name, header=False))[0][0] == error
    assert service.catalog.by_name("t").files == ()
    assert os.listdir(settings.table_folder) == []
    assert problems(service, load(service, file="none.csv"))[0][0] == "Failed to find input file"
    assert problems(service, load(service, name="none"))[0][0] == "Undefined table name"


def test_destination_columns(service, settings):
    with open(os.path.join(settings.data_folder, "x.csv"), "w") as file:
        file.write('a,b,c\n"d,e",f,g,spare,more\n')
    service.create_table({"name": "t", "columns": [{"name": c, "type": "VARCHAR"} for c in "xyz"]})
    for columns, context in ((["x"], "1 for 3 columns"), (["x", "x", "y"], "x is given twice"), (["x", "y", "w"], "w is not a column")):
        assert problems(service, load(service, file="x.csv", header=False, columns=columns)) == [("Destination column error", context)]
    # Column x takes the field at the place of y, and so on around.
    load(service, file="x.csv", header=False, columns=["y", "z", "x"])
    assert rows(service, everything("t", "x", "y", "z")) == [("b", "c", "a"), ("f", "g", "d,e")]
    with open(os.path.join(settings.data_folder, "short.csv"), "w") as file:
        file.write("a,\n")
    assert problems(service, load(service, file="short.csv", header=False, columns=["y", "z", "x"]))[0][0] == "Invalid CSV file"


def test_failures_while_running(service):
    service.create_table({"name": "t", "columns": COLUMNS})
    load(service)
    assert problems(service, query(service, select(op("DIVIDE", 1, col("t", "id"))))) == [("Division by zero", "1 / 0")]
    # All rows of an ordered result are projected, also those that the limit drops.
    assert problems(service, query(service, select(col("t", "id"), op("DIVIDE", 1, op("SUBTRACT", col("t", "id"), 3)), order=[(0, True)], limit=1)))[0][0] == "Division by zero"
    task = query(service, select(op("EQUAL", 1, 1)))
    assert problems(service, task)[0][0].startswith("Unexpected error")
    assert service.describe_query(task.id) == {"queryId": task.id, "status": "FAILED", "isResultAvailable": False}


def test_results(service):
    task = query(service, select())
    assert list(service.result(task.id)) == []
    task = query(service, select(1, "ab"))
    assert list(service.result(task.id)) == [{"rowCount": 1, "columns": [[1], ["ab"]]}]
    assert service.describe_query(task.id) == {"queryId": task.id, "status": "COMPLETED", "isResultAvailable": True, "queryDefinition": select(1, "ab")}
    assert list(service.result(task.id, {"rowLimit": 0})) == []
    assert len(list(service.result(task.id, {"flushResult": True}))) == 1
    assert service.task(task.id) is None and service.result(task.id) is None
    assert service.list_queries()[0]["status"] == "COMPLETED"


def test_http(service):
    server = make_server(service)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        connection = http.client.HTTPConnection(*server.server_address)
        connection.request(method, path, None if body is None else json.dumps(body))
        response = connection.getresponse()
        data = response.read()
        return response.status, json.loads(data) if data else None

    try:
        status, table = call("PUT", "/table", {"name": "t", "columns": COLUMNS})
        assert status == 200
        assert call("PUT", "/table", {"name": "t", "columns": COLUMNS})[0] == 400
        assert call("PUT", "/table", {"name": "u", "columns": [{"name": "c", "type": "5"}]})[0] == 400
        assert call("GET", f"/table/{table}") == (200, {"name": "t", "columns": COLUMNS})
        assert {"tableId": table, "name": "t"} in call("GET", "/tables")[1]
        assert call("POST", "/query", {"queryDefinition": {}})[0] == 400
        _, copy = call("POST", "/query", {"queryDefinition": {"sourceFilepath": "people.csv", "destinationTableName": "t", "doesCsvContainHeader": True}})
        service.wait(copy)
        assert call("GET", f"/result/{copy}")[0] == 404
        _, found = call("POST", "/query", {"queryDefinition": everything()})
        service.wait(found)
        assert call("GET", f"/query/{found}")[1]["status"] == "COMPLETED"
        assert call("GET", f"/result/{found}", {"rowLimit": 2}) == (200, [{"rowCount": 2, "columns": [[0, 1], ["Ann", 'Bo, "B" '], [24, 25]]}])
        assert call("GET", f"/error/{found}")[0] == 404
        _, bad = call("POST", "/query", {"queryDefinition": select(col("none", "a"))})
        service.wait(bad)
        assert call("GET", f"/error/{bad}") == (200, {"problems": [{"error": "Table not found", "context": "none"}]})
        assert {"queryId": bad, "status": "FAILED"} in call("GET", "/queries")[1]
        info = call("GET", "/system/info")[1]
        assert info["uptime"] >= 0 and info["interfaceVersion"] == "1.0.1"
        assert call("GET", "/query/none")[0] == 404 and call("GET", "/nothing")[0] == 404
        assert call("DELETE", f"/table/{table}") == (200, None)
        assert call("GET", f"/table/{table}")[0] == 404
    finally:
        server.shutdown()
        server.server_close()


def test_settings_from_the_environment():
    with pytest.raises(KeyError, match="METASTORE_PATH"):
        Settings.from_environment({"TABLE_DIRECTORY": "t", "RESULT_DIRECTORY": "r", "DATA_DIRECTORY": "d"})
    found = Settings.from_environment({"TABLE_DIRECTORY": "t", "RESULT_DIRECTORY": "r", "DATA_DIRECTORY": "d", "METASTORE_PATH": "m", "BUFFER_SIZE": "9"})
    assert (found.catalog_path, found.chunk_bytes) == ("m", 9)
