"""Build order of assets and checks of raw manifests against plain versions."""

from __future__ import annotations

import json
import random

from editlens.operators import manifest_fields, stages


def plain_stages(rows):
    references, providers = {a: r for a, r, _ in rows}, {a: p for a, _, p in rows}
    turn = lambda a: (stages.PROVIDER_ORDER.index(providers[a]) + 1) if providers[a] in stages.PROVIDER_ORDER else 0
    for asset, reference in references.items():
        path, at = [asset], reference
        while at is not None and at in references and at not in path:
            path.append(at)
            at = references[at]
        depth = len(path) - 1
        if at is None:
            late = reference is not None and turn(reference) > turn(asset)
            yield asset, depth, "late_reference" if late else "independent" if depth == 0 else "generate_after"
        elif at not in references:
            yield asset, None, "dangling" if depth == 0 else "behind_dangling"
        else:
            yield asset, None, "cycle" if at == asset else "behind_cycle"


def test_stages(spark):
    """Long chains, cycles of several lengths with tails, a voice that most assets refer to, and copies."""
    rng = random.Random(5)
    rows = [("hot", None, "qwen3_tts")] + [(f"h{i}", "hot", rng.choice([*stages.PROVIDER_ORDER, "other", None])) for i in range(60)]
    rows += [(f"c{i}", f"c{i - 1}" if i else None, "voxcpm2") for i in range(70)]
    for k, length in enumerate((1, 2, 5)):
        rows += [(f"o{k}_{i}", f"o{k}_{(i + 1) % length}", None) for i in range(length)]
        rows += [(f"t{k}_{i}", f"t{k}_{i - 1}" if i else f"o{k}_0", None) for i in range(9)]
    rows += [("x0", "nowhere", None), ("x1", "x0", None), ("x2", "x1", None)]
    table = spark.createDataFrame([*rows, *rows[:5], (None, "hot", None)], "asset_id string, reference_asset_id string, provider string")
    got = sorted((r.asset_id, r.stage, r.status) for r in stages.asset_stages(table).collect())
    assert got == sorted(plain_stages(rows))
    assert stages.asset_stages(table.filter("asset_id = 'none'")).count() == 0


def test_manifest_fields(spark):
    segment = '{"word":"a","start":0,"end":1}'
    alignment = f'{{"audio_sha256":"s","text_sha256":"t","segments":[{segment},{segment}]}}'
    case = f'{{"id":"c","language":"en","source_audio":{{"asset_id":"a","path":"p","sha256":"s"}},"instruction_xml":"x","annotations":{{"source_alignment":{alignment}}}}}'
    good = f'{{"category":"text","shard":"easy","audio_assets":{{"a":{{}}}},"cases":[{case},{case}]}}'
    at = "$.cases[1].annotations.source_alignment"
    last = good.rindex(segment)
    texts = {
        "good": (good, []),
        "segment": (good[:last] + '{"word":"a","\\u0077ord":"b","start":0,"stop":1}' + good[last + len(segment) :], [("C01", f"{at}.segments[1].end", "missing field"), ("C01", f"{at}.segments[1].stop", "unknown field"), ("C02", f"{at}.segments[1].word", "duplicate key")]),
        "prosody": (good.replace('"text"', '"prosody"', 1), [("C01", f"$.cases[{i}].annotations.span_granularity", "missing field") for i in (0, 1)]),
        "emotion": (good.replace('"text"', '"emotion"', 1).replace('"annotations":{', '"annotations":{"source_emotion":"sad",', 1), []),
        "shape": (good.replace(f"[{case},{case}]", '{"a":1,"a":2}'), [("C01", "$.cases", "no list"), ("C02", "$.cases.a", "duplicate key")]),
        "inner": (good.replace('"a":{}', '"a":{"parameters":[{"k":1,"k":1}]}'), [("C02", "$.audio_assets.a.parameters[0].k", "duplicate key")]),
        "list": ("[]", [("C01", "$", "no object")]),
        "broken": (good[:-1], [("C01", "$", "no JSON")]),
        "null": (None, [("C01", "$", "no object")]),
    }
    raw = spark.createDataFrame([(k, t, 1) for k, (t, _) in texts.items()], "key string, json string, path int")
    got = sorted(tuple(r) for r in manifest_fields.check_manifests(raw).collect())
    assert got == sorted((c, k, p, d) for k, (_, found) in texts.items() for c, p, d in found)
    assert json.loads(good)["shard"] == "easy"
