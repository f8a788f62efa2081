"""Charts, resources and their merging: odd forms, foreign folders, empty tables."""

from corpusloom.sources import services

CHARTS = {
    "a/Chart.yaml": ('apiVersion: v2\nname: web # front\ndependencies:\n- name: db\n  alias: x\n- alias: y\n  name: "cache"\nicon: x\n', ("web", ["db", "cache"])),
    "b/Chart.yml": ("name: 'alone'\r\nversion: 1\r\n", ("alone", [])),
    "c/Chart.yaml": ("version: 1\ndependencies:\n  - name: db\n", None),
    "d/Chart.yaml": ("dependencies:\n  # all\n  -   name: one\n\n  -   tags:\n        - name: no\n      name: two\nname: late\nannotations:\n  name: other\n", ("late", ["one", "two"])),
    "vendor/Chart.yaml": ("name: foreign\n", None),
    "e/MyChart.yaml": ("name: other\n", None),
    "f/Chart.yaml": ("", None),
    "g/Chart.yaml": (None, None),
}
TF = 'resource "aws_ecs_service" "web" {\n  a = aws_db_instance.main.arn\n  b = aws_db_instance.main.id\n  c = aws_ecs_service.web.id\n}\nresource "aws_iam_role" "role" {\n  x = aws_sqs_queue.jobs.arn\n}\nresource "aws_db_instance" "main" {\n}\n'


def test_charts(spark):
    rows = spark.createDataFrame([(p, t) for p, (t, _) in CHARTS.items()], "path string, text string")
    got = {r.path: (r.name, r.depends_on) for r in services.chart_services(rows).collect()}
    assert got == {p: w for p, (_, w) in CHARTS.items() if w}


def test_resources(spark):
    rows = spark.createDataFrame([("main.tf", TF), ("x/node_modules/a.tf", TF), ("m.bicep", "resource q 'Microsoft.ServiceBus/queues@1' = {\n}\nresource  s 'Microsoft.Web/sites' = {"), ("n.tf", None)], "path string, text string")
    got = {r.name: (r.type, sorted(r.depends_on), r.path) for r in services.resource_services(rows).collect()}
    # What lies within reach of a head counts, in later blocks too.
    assert got == {"web": ("aws_ecs_service", ["jobs", "main"], "main.tf"), "main": ("aws_db_instance", [], "main.tf"), "q": ("Microsoft.ServiceBus/queues", [], "m.bicep"), "s": ("Microsoft.Web/sites", [], "m.bicep")}
    far = TF.replace("}\nresource \"aws_iam", "}\n" + "#" * services.BLOCK + "\nresource \"aws_iam")
    again = {r.name: sorted(r.depends_on) for r in services.resource_services(spark.createDataFrame([("main.tf", far)], "path string, text string")).collect()}
    assert again["web"] == ["main"]


def test_one_map(spark):
    rows = spark.createDataFrame([("z/docker-compose.yml", "services:\n  web:\n    image: nginx\n    ports: [80]\n  main:\n    image: postgres:16\n"), ("a/Chart.yaml", CHARTS["a/Chart.yaml"][0]), ("m/main.tf", TF)], "path string, text string")
    got = {r.name: (r.kind, r.image, r.depends_on, r.ports) for r in services.service_map(services.infra_services(rows)).collect()}
    assert got == {"web": ("service", "nginx", ["cache", "db", "jobs", "main"], ["80"]), "main": ("service", "postgres:16", [], [])}  # the kind of the first path
    assert services.service_map(services.infra_services(rows.limit(0))).count() == 0
