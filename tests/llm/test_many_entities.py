"""More entities than one format has surrogates."""

from quillgrid.llm import surrogates


def test_surrogates_grow(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "SYLLABLES", surrogates.SYLLABLES[:2])       # 16 single names of four syllables
    names = [("name", f"m:Real{chr(97 + k // 26)}{chr(97 + k % 26)}") for k in range(100)]
    mails = [("email", f"{a}@{b}.co") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    secrets = [("secret", "_" * k) for k in (12, 13)]
    got = surrogates.mapping(spark.createDataFrame(names + mails + secrets, "kind string, entity string")).collect()
    assert len(got) == len({(r.kind, r.fake) for r in got}) == len(names + mails + secrets)
    assert not {(r.kind, r.fake) for r in got} & {(k, e.removeprefix("m:")) for k, e in names + mails + secrets}
