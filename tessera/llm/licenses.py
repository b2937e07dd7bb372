"""License scans by sentence rules.

A text is normalised and cut into sentences, each run of whole lines within one that equals a known
licence sentence is mapped to its id (so hard-wrapped sentences and single lines count alike), and
the sequence of ids is matched against ordered rules: a rule holds where its ids occur in
order, next to each other among the known sentences. The tables are fixed and small, so they
are literals of the plan: no join, no shuffle, one pass over whole texts. Only DataFrame
functions run here; ``sql.py`` says the same for another engine, of the short sentences on one line each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text

# Sentences of well-known licences, as they read after normalising.
SENTENCES: dict[str, str] = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-the": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-title": "apache license version 2 0",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-title-the": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice-kept": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-title": "gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "lgpl-notice": "this work is licensed under the gnu lesser general public license version 3",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-notice": "released under the bsd license",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc0-notice": "released under cc0 1 0",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
}

# Rules in order of precedence (licence, sentence ids in order).
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache-notice-the", "apache-comply"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-title"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("MIT", ["mit-grant", "mit-notice-kept"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-title-the"]),
    ("MIT", ["spdx-mit"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL-3.0", ["spdx-gpl3"]),
    ("GPL", ["gpl-free"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("LGPL-3.0", ["lgpl-notice"]),
    ("BSD", ["bsd-grant", "bsd-source"]),
    ("BSD", ["bsd-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("ISC", ["isc-grant"]),
]

# The sentences of the published texts, where they are longer than the short forms above or
# are cut elsewhere (id, sentence as it reads after normalising).
PUBLISHED: list[tuple[str, str]] = [
    ("apache-title", "apache license version 2 0 january 2004"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl3-title", "gnu general public license version 3 29 june 2007"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    ("gpl-free", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl2-notice", "gnu general public license version 2 june 1991"),
    ("lgpl-notice", "gnu lesser general public license version 3 29 june 2007"),
    ("cc-by-nc-notice", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-notice", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0-notice", "cc0 1 0 universal"),
    ("mpl-notice", "mozilla public license version 2 0"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
]

#: Sentences end at . ! ? ; before white space or the end of the text, but not after the abbreviation "v.".
END = r"(?<!\bv)[.!?;]+(?=\s|\z)"
#: A text without any of these holds no known sentence, and isn't normalised.
HINT = "(?i)licen[cs]e|permi|redistribut|warranty|cc|spdx"
#: A known sentence from the start of a line or sentence to the end of one: the longest that fits, over single line breaks.
KNOWN = r"(?:\A|\n)(" + "|".join(s.replace(" ", "[ \\n]") for s in sorted({*SENTENCES.values(), *(s for _, s in PUBLISHED)}, key=lambda s: (-len(s), s))) + r")(?=\n|\z)"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, license, rule, n_matches``: one row for each rule that a text matches.

    ``rule`` is the rule's place in ``RULES``, ``n_matches`` how often its ids follow each other among
    the text's known sentences (matches of one rule do not overlap). Sentences are lower-cased in A-Z, and every run of other
    characters than a-z, 0-9 and non-ASCII becomes a space, comment signs at a line's start too. A sentence may
    be wrapped over lines; it ends at a blank line, an end mark, or where a known one is whole at a line's end. Null and empty texts, and texts
    without a known sentence, give no rows; repeated rows give rows each.
    """
    hinted = id_and_text(docs).where(F.col("text").rlike(HINT))
    known = F.create_map(*[F.lit(x) for name, sentence in [*SENTENCES.items(), *PUBLISHED] for x in (sentence, name)])
    ended = F.regexp_replace(F.lower("text"), END, "\n\n")
    plain = F.regexp_replace(F.regexp_replace(ended, "[^a-z0-9\\x{80}-\\x{10FFFF}\n]+", " "), "\\A | ?\n ?| \\z", "\n")
    ids = F.transform(F.regexp_extract_all(plain, F.lit(KNOWN), F.lit(1)), lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))
    sequence = hinted.select("doc_id", F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("seq")).where("seq <> ''")
    rules = F.array(
        *[
            F.struct(F.lit(name).alias("license"), F.lit(k).alias("rule"), F.regexp_count("seq", F.lit("".join(f"<{x}>" for x in ids_))).cast("int").alias("n_matches"))
            for k, (name, ids_) in enumerate(RULES)
        ]
    )
    return sequence.select("doc_id", F.inline(F.filter(rules, lambda r: r["n_matches"] > 0)))
