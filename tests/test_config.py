import pytest

from quire.operators.config import find_program, load_config

NAMES = {"model": "M", "api_key": "K"}


def test_environment_wins(tmp_path):
    (tmp_path / ".env").write_text("# c\nM='from file'\nexport K=abc\n\nnonsense\n")
    assert load_config(NAMES, {}, str(tmp_path / ".env")).model == "from file"
    config = load_config(NAMES, {"M": "env"}, str(tmp_path / ".env"))
    assert (config.model, config.require_key(), config.base_url) == ("env", "abc", None)
    with pytest.raises(RuntimeError):
        load_config(NAMES, {"K": ""}).require_key()


def test_program(tmp_path):
    (tmp_path / "tool-of-ours").write_text("")
    assert find_program("tool-of-ours", str(tmp_path)) == str(tmp_path / "tool-of-ours")
    assert find_program("tool-of-ours", None, [str(tmp_path / "none"), str(tmp_path / "tool-of-ours")]) == str(tmp_path / "tool-of-ours")
    assert find_program("tool-of-ours") is None and find_program("sh")
