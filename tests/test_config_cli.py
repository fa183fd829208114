import pytest

from tallyforge import EnrichmentConfig, SummaryConfig
from tallyforge.cli import catalog_parser, main, vocabulary_of


def test_yaml_and_overrides(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("summary: {split_columns: true}\nprivacy: {min_subjects: 3}\nenrichment: {csv_dir: vocab, child_depth: 2}\n")
    config = SummaryConfig.from_yaml(path)
    assert (config.split_columns, config.min_subjects, config.partitions) == (True, 3, 256)
    assert config.enrichment == EnrichmentConfig(csv_dir=tmp_path / "vocab", child_depth=2)
    assert config.with_overrides(min_subjects=None, round_counts_to=5).round_counts_to == 5
    path.write_text("enrichment:\n")
    assert SummaryConfig.from_yaml(path).enrichment is None


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("[1]", "must be a mapping"),
        ("other: {}", "Unknown YAML sections"),
        ("summary: {min_subjects: 3}", "wrong sections"),
        ("privacy: [1]", "section 'privacy'"),
        ("enrichment: {csv_dir: 3}", "csv_dir must be a path"),
        ("summary: {per_split: true, split_columns: true}", "mutually exclusive"),
    ],
)
def test_strict_yaml(tmp_path, text, message):
    path = tmp_path / "bad.yaml"
    path.write_text(text)
    with pytest.raises(ValueError, match=message):
        SummaryConfig.from_yaml(path)


@pytest.mark.parametrize(
    "bad",
    [
        {"min_subjects": 0},
        {"min_subjects": True},
        {"partitions": 1.5},
        {"rare_code_action": "keep"},
        {"rare_code_label": ""},
        {"round_counts_to": 0},
        {"per_split": 1},
        {"enrichment": "x"},
    ],
)
def test_bad_values(bad):
    with pytest.raises(ValueError):
        SummaryConfig(**bad)


@pytest.mark.parametrize(
    "bad", [{}, {"csv_dir": "a", "postgres": "b"}, {"postgres": " "}, {"csv_dir": "a", "child_depth": 101}, {"csv_dir": "a", "child_codes": 1}]
)
def test_bad_enrichment(bad):
    with pytest.raises(ValueError):
        EnrichmentConfig(**bad)


def test_source_on_the_command_line_replaces(tmp_path):
    args = catalog_parser().parse_args(["d", "-o", "x.csv", "--athena-csv", "v", "--child-codes"])
    made = vocabulary_of(args, EnrichmentConfig(postgres="p", child_depth=9))
    assert made == EnrichmentConfig(csv_dir="v", child_codes=True)
    with pytest.raises(ValueError, match="require an Athena"):
        vocabulary_of(catalog_parser().parse_args(["d", "-o", "x.csv", "--no-parent-codes"]))


def test_command(spark, dataset, tmp_path, capsys):
    config = tmp_path / "c.yaml"
    config.write_text("summary: {split_columns: true, partitions: 2}\nprivacy: {min_subjects: 1, min_split_subjects: 2}\n")
    target = tmp_path / "o.parquet"
    assert main([str(dataset), "-o", str(target), "-c", str(config), "--min-subjects", "3"]) == 0
    assert f"Wrote {target}" in capsys.readouterr().out
    import pyarrow.parquet as pq

    rows = pq.read_table(target).to_pylist()
    assert [r["code"] for r in rows] == ["A", "__RARE__"]
    assert all(r["event_count_held_out"] is None for r in rows)
    with pytest.raises(SystemExit) as stop:
        main([str(dataset), "-o", str(target), "--min-subjects", "0"])
    assert stop.value.code == 2
    with pytest.raises(SystemExit) as stop:
        main([str(tmp_path / "nowhere"), "-o", str(target)])
    assert stop.value.code == 1
