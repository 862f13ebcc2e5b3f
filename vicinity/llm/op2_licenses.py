"""License scans by ordered signature rules, in DataFrame functions only.

Text is read as words: A-Z become small letters, and digits, letters and everything outside ASCII make words.
Documents without the keyword of any rule are settled by one test of all keywords. Of the others, every rule whose
keyword occurs is matched over the word sequence; a detection has the rule's priority (smaller is stronger). Overlapping
detections are resolved by containment: one that lies within a detection of stronger priority, or within a longer
one of the same priority, or within an equal one of an earlier rule, is suppressed. The rules are patterns of
license names, each in several settings (identifier line, grant, reference, bare name), and signature sentences
of license texts.

Everything happens in the row, as arrays: nothing is shuffled. Defined results: a null or empty text has no words
and no labels; repeated rows give equal values; ties keep the rule that comes first; other columns stay (a
clashing ``licenses`` column is replaced); an empty table stays empty.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, free, whole_text
from ._spans import match_spans, scanned, within

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Phrases that are reported at every place, whatever the rules say.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
VERSION = "(?: (?:version|v))?"
LATER = "(?: or(?: any)? later(?: version)?| or at your option any later version)?"
#: Label, keyword (which every match of the name has), identifier and name of each license family, as patterns over
#: words parted by single spaces.
FAMILIES = (
    ("apache-1.1", "apache", "apache 1 1", f"apache(?: software)? license{VERSION} 1 1"),
    ("apache-1", "apache", "apache 1 0", f"apache(?: software)? license{VERSION} 1(?: 0)?"),
    ("apache-2", "apache", "apache 2 0", f"apache(?: software)?(?: license)?{VERSION} ?2(?: 0)?(?: license)?"),
    ("mit", "mit license", "mit", "(?:the )?(?:expat |x11 )?mit license"),
    ("mit-0", "mit no attribution", "mit 0", "mit no attribution(?: license)?"),
    ("isc", "isc license", "isc", "isc license"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", "(?:simplified|freebsd|2 clause|two clause) bsd(?: license)?|bsd 2 clause(?: license)?"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", "(?:new|modified|revised|3 clause|three clause) bsd(?: license)?|bsd 3 clause(?: license)?"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", "(?:original|old|4 clause|four clause) bsd(?: license)?|bsd 4 clause(?: license)?"),
    ("bsd-zero", "bsd", "0bsd", "(?:zero clause|0 clause) bsd(?: license)?"),
    ("bsd", "bsd", "bsd", "bsd(?: style)? license"),
    ("gpl-1", "gpl", "gpl 1 0", f"gpl{VERSION} ?1(?: 0)?{LATER}"),
    ("gpl-2", "gpl", "gpl 2 0(?: only| or later)?", f"gpl{VERSION} ?2(?: 0)?{LATER}"),
    ("gpl-3", "gpl", "gpl 3 0(?: only| or later)?", f"gpl{VERSION} ?3(?: 0)?{LATER}"),
    ("gpl-2", "general public", "gnu gpl 2", f"gnu general public license{VERSION} 2(?: 0)?{LATER}"),
    ("gpl-3", "general public", "gnu gpl 3", f"gnu general public license{VERSION} 3(?: 0)?{LATER}"),
    ("gpl", "gnu", "gnu gpl", "gnu(?: general public license| gpl)"),
    ("lgpl-2.1", "lgpl", "lgpl 2 1(?: only| or later)?", f"lgpl{VERSION} ?2 1{LATER}"),
    ("lgpl-3", "lgpl", "lgpl 3 0(?: only| or later)?", f"lgpl{VERSION} ?3(?: 0)?{LATER}"),
    ("lgpl-2.1", "general public", "gnu lgpl 2 1", f"gnu (?:lesser|library) general public license{VERSION} 2 1{LATER}"),
    ("lgpl-3", "general public", "gnu lgpl 3", f"gnu lesser general public license{VERSION} 3(?: 0)?{LATER}"),
    ("lgpl", "gnu", "gnu lgpl", "gnu (?:lesser|library)(?: general)? public license"),
    ("agpl-3", "agpl", "agpl 3 0(?: only| or later)?", f"agpl{VERSION} ?3(?: 0)?{LATER}"),
    ("agpl-3", "affero", "gnu agpl 3", f"(?:gnu )?affero general public license(?:{VERSION} 3(?: 0)?)?{LATER}"),
    ("gfdl", "free documentation", "gfdl", f"gnu free documentation license(?:{VERSION} 1 [1-3])?"),
    ("mpl-1.1", "mozilla", "mpl 1 1", f"mozilla public license{VERSION} 1 1"),
    ("mpl-2", "mozilla", "mpl 2 0", f"mozilla public license{VERSION} 2(?: 0)?"),
    ("mpl-2", "mpl", "mpl 2 0(?: no copyleft exception)?", f"mpl{VERSION} ?2(?: 0)?"),
    ("epl-1", "eclipse", "epl 1 0", f"eclipse public license{VERSION} 1(?: 0)?"),
    ("epl-2", "eclipse", "epl 2 0", f"eclipse public license{VERSION} 2(?: 0)?"),
    ("edl-1", "eclipse", "edl 1 0", f"eclipse distribution license{VERSION} 1(?: 0)?"),
    ("cddl", "common development", "cddl 1 [01]", f"common development and distribution license(?:{VERSION} 1(?: [01])?)?"),
    ("eupl", "european union", "eupl 1 [012]", f"european union public licen[cs]e(?:{VERSION} 1 [012])?"),
    ("artistic-2", "artistic", "artistic 2 0", f"artistic license(?:{VERSION} 2(?: 0)?)?"),
    ("bsl-1", "boost", "bsl 1 0", f"boost software license(?:{VERSION} 1(?: 0)?)?"),
    ("zlib", "zlib", "zlib", "zlib(?: libpng)? license"),
    ("python-2", "python software foundation", "psf 2 0|python 2 0", f"python software foundation license(?:{VERSION} 2)?"),
    ("postgresql", "postgresql", "postgresql", "postgresql licen[cs]e"),
    ("ofl-1.1", "open font", "ofl 1 1", f"(?:sil )?open font license(?:{VERSION} 1 [01])?"),
    ("wtfpl", "do what the", "wtfpl", "do what the [a-z]+ you want to public license"),
    ("unlicense", "unlicense", "unlicense", "the unlicense"),
    ("cc0", "cc0", "cc0 1 0", f"cc0(?:{VERSION} 1(?: 0)?)?(?: universal)?"),
    ("cc-by", "cc by", "cc by [1-4] 0", "cc by(?: [1-4](?: [05])?)?(?: license)?"),
    ("cc-by-sa", "cc by sa", "cc by sa [1-4] 0", "cc by sa(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", "cc by nd", "cc by nd [1-4] 0", "cc by nd(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "cc by nc", "cc by nc [1-4] 0", "cc by nc(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa [1-4] 0", "cc by nc sa(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd [1-4] 0", "cc by nc nd(?: [1-4](?: [05])?)?"),
    ("cc-by", "creative commons", "creative commons by", "creative commons attribution(?: license)?(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-sa", "creative commons", "creative commons by sa", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", "creative commons", "creative commons by nc", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-sa", "creative commons", "creative commons by nc sa", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-nd", "creative commons", "creative commons by nc nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?"),
    ("odbl-1", "open database", "odbl 1 0", f"open database license(?:{VERSION} 1(?: 0)?)?"),
    ("odc-by", "open data commons", "odc by 1 0", "open data commons attribution license"),
    ("pddl-1", "public domain dedication", "pddl 1 0", "(?:open data commons )?public domain dedication and license"),
    ("sspl-1", "server side", "sspl 1 0", f"server side public license(?:{VERSION} 1)?"),
    ("busl-1.1", "business source", "busl 1 1", "business source license(?: 1 1)?"),
    ("elastic-2", "elastic license", "elastic 2 0", f"elastic license(?:{VERSION} 2(?: 0)?)?"),
    ("openrail", "open", "(?:creativeml )?openrail m", "(?:creativeml |bigscience )?(?:open ?rail|openrail)(?: m)?(?: license)?"),
    ("ms-pl", "microsoft public", "ms pl", "microsoft public license"),
    ("ncsa", "ncsa", "ncsa", "university of illinois ncsa open source license"),
    ("vim", "vim license", "vim", "vim license"),
    ("php-3", "php license", "php 3 0[01]?", f"php license(?:{VERSION} 3 0[01]?)?"),
    ("ruby", "ruby license", "ruby", "ruby license"),
    ("openssl", "openssl license", "openssl", "openssl license"),
    ("json", "json license", "json", "json license"),
)
#: Settings of a family: name, priority, confidence and the pattern around its identifier or name.
SETTINGS = (
    ("identifier", 0, 1.0, "spdx license identifier (?:{id})"),
    ("grant", 1, 0.95, "(?:is|are|was|be) (?:released|licensed|distributed|available|provided|published|made available)(?: [a-z]+)? under (?:the )?(?:terms of (?:the )?)?(?:{name})"),
    ("under", 2, 0.9, "(?:released|licensed|distributed|available)? ?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})"),
    ("bare", 3, 0.6, "(?:{name})"),
)
#: Sentences that stand in license texts: label, keyword, pattern.
SENTENCES = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd-3-clause", "endorse or promote", "neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "apache org licenses", "you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("gpl", "free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2", "either version 2", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "either version 3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "lesser general public", "modify it under the terms of the gnu lesser general public license as published by"),
    ("agpl-3", "affero general public", "modify it under the terms of the gnu affero general public license as published by"),
    ("mpl-2", "mozilla public", "subject to the terms of the mozilla public license v 2 0"),
    ("zlib", "as is without any express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1", "boost software", "distributed under the boost software license version 1 0"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "just do what the", "you just do what the [a-z]+ you want to"),
    ("cc0", "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creativecommons org licenses by ", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd [1-4] [05]"),
    ("public-domain", "public domain", "(?:dedicated to|released into|placed in|in) the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)
#: Further sentences of license texts and grants, most of them from the middle of a text: label, keyword, pattern.
CLAUSES = (
    ("mit", "including without limitation the rights", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", "above copyright notice and this permission notice shall", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "warranties of merchantability fitness for a particular purpose and noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders"),
    ("mit", "the software is provided as is without warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("mit-0", "without restriction including", "permission is hereby granted .{1,200}? without restriction including .{1,200}? to permit persons to whom the software is furnished to do so the software is provided"),
    ("isc", "author disclaims all warranties", "the author disclaims all warranties with regard to this software including all implied warranties"),
    ("bsd-zero", "to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd", "copyright holders and contributors as is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd-3-clause", "neither the name of the university", "neither the name of the university nor the names of its contributors"),
    ("bsd-4-clause", "this product includes software developed by", "this product includes software developed by (?:the )?[a-z0-9 ]{1,80}? and its contributors"),
    ("apache-2", "unless required by applicable law or agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "terms and conditions for use reproduction and distribution", "apache license version 2 0 january 2004 (?:[^ ]+ ){0,8}?terms and conditions for use reproduction and distribution"),
    ("apache-2", "licensed to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl", "without even the implied warranty", "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "terms and conditions for copying", "gnu general public license terms and conditions for copying distribution and modification"),
    ("gpl-2", "june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-3", "29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("gpl", "dual licensed", "dual licensed under (?:the )?(?:[a-z]+ and (?:the )?)?gpl"),
    ("lgpl", "you should have received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    ("lgpl", "you should have received a copy of the gnu library", "you should have received a copy of the gnu library general public license"),
    ("lgpl-2.1", "february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "additional permissions listed below", "supplemented by the additional permissions listed below"),
    ("agpl-3", "19 november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", "remote network interaction", "remote network interaction use with the gnu general public license"),
    ("agpl-3", "you should have received a copy of the gnu affero", "you should have received a copy of the gnu affero general public license"),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mpl was not distributed", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "contents of this file are subject to the mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "covered software", "covered software is provided under this license on an as is basis without warranty of any kind"),
    ("epl-1", "accompanying materials are made available under", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "accompanying materials are made available under", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-1", "agreement eclipse public", "the accompanying program is provided under the terms of this eclipse public license agreement eclipse public license"),
    ("cddl", "cddl header start", "cddl header start"),
    ("cddl", "common development and distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1", "common public license", "provided under the terms of this common public license"),
    ("ibm-pl", "ibm public license", "provided under the terms of this ibm public license"),
    ("eupl", "licensed under the eupl", "licensed under the eupl(?: version)?(?: 1 [012])?"),
    ("artistic-1", "artistic license", "under the same terms as perl itself (?:[^ ]+ ){0,12}?artistic license"),
    ("perl", "same terms as perl", "(?:under|on) the same terms as perl(?: itself)?"),
    ("artistic-2", "standard version", "the package is distributed with the standard version under the artistic license 2 0"),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "origin of this software must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "libpng", "(?:this code is released under|see) the libpng license"),
    ("bsl-1", "machine executable object code generated by a source language processor", "solely in the form of machine executable object code generated by a source language processor"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young"),
    ("php-3", "this product includes php", "this product includes php (?:software )?freely available from"),
    ("python-2", "psf hereby grants licensee", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("cnri-python", "cnri hereby grants licensee", "cnri hereby grants licensee a nonexclusive royalty free world wide license"),
    ("postgresql", "without a written agreement is hereby granted", "for any purpose without fee and without a written agreement is hereby granted"),
    ("ofl-1.1", "reserved font name", "with reserved font name"),
    ("ofl-1.1", "this font software is licensed under", "this font software is licensed under the sil open font license"),
    ("bitstream-vera", "bitstream vera", "bitstream vera is a trademark of bitstream"),
    ("unlicense", "anyone is free to copy modify publish", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "waived all copyright and related", "has waived all copyright and related or neighboring rights"),
    ("cc0", "to the extent possible under law", "to the extent possible under law .{1,120}? has waived"),
    ("cc-by", "you must give appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "you must distribute your contributions under the same license", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", "you may not use the material for commercial purposes", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "you may not distribute the modified material", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc", "some rights reserved", "some rights reserved"),
    ("cc", "licensed under a creative commons", "(?:this work is|are|is) licensed under a creative commons"),
    ("odbl-1", "freely share modify and use this database", "freely share modify and use this database while maintaining this same freedom for others"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("beerware", "buy me a beer", "you can buy me a beer in return"),
    ("sspl-1", "offering the program as a service", "(?:section 13 )?offering the program as a service"),
    ("busl-1.1", "change date", "change date .{1,40}? change license"),
    ("busl-1.1", "additional use grant", "additional use grant"),
    ("elastic-2", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "commons clause", "commons clause license condition"),
    ("commons-clause", "does not include and the license does not grant to you the right to sell", "does not include and the license does not grant to you the right to sell the software"),
    ("openrail", "use based restrictions", "use based restrictions as referenced in paragraph 5"),
    ("llama-2", "llama 2 community license", "llama 2 community license agreement"),
    ("llama-3", "llama 3", "llama 3(?: [0-9])? community license agreement"),
    ("gemma", "gemma terms of use", "gemma terms of use"),
    ("ms-pl", "microsoft limited public", "microsoft limited public license"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal license"),
    ("upl-1", "universal permissive", "universal permissive license(?: v| version)?(?: 1 0)?"),
    ("afl-3", "academic free", "academic free license(?: v| version)?(?: 3 0)?"),
    ("osl-3", "open software license", "open software license(?: v| version)?(?: 3 0)?"),
    ("ecl-2", "educational community", "educational community license(?: v| version)?(?: 2 0)?"),
    ("w3c", "w3c software", "w3c software (?:notice and (?:document )?license|license)"),
    ("x11", "except as contained in this notice", "except as contained in this notice the name of .{1,80}? shall not be used in advertising"),
    ("hpnd", "historical permission notice", "historical permission notice and disclaimer"),
    ("icu", "icu license", "icu license icu 1 8 1 and later"),
    ("unicode", "unicode", "unicode (?:inc )?license agreement data files and software"),
    ("tcl", "government use", "government use if you are acquiring this software on behalf of the u s government"),
    ("mulan-2", "mulan", "mulan (?:psl v2|permissive software license(?: v| version)? ?2)"),
    ("blueoak-1", "blue oak", "blue oak model license(?: 1 0 0)?"),
    ("qpl-1", "q public", "(?:the )?q public license(?: version)?(?: 1 0)?"),
    ("sleepycat", "sleepycat", "sleepycat license"),
    ("proprietary", "confidential and proprietary", "(?:this (?:file|software|document) is )?confidential and proprietary"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this (?:file|software) via any medium is strictly prohibited"),
    ("proprietary", "may not be reproduced", "may not be reproduced (?:or )?(?:distributed |copied )?(?:in whole or in part )?without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)"),
    ("proprietary", "end user license agreement", "end user license agreement"),
    ("public-domain", "no copyright", "no copyright is claimed"),
    ("public-domain", "work of the united states government", "(?:is a )?work of the united states government"),
)
#: Addresses of license texts, as words: label, keyword, pattern.
ADDRESSES = (
    ("mit", "opensource org", "opensource org licenses? mit"),
    ("isc", "opensource org", "opensource org licenses? isc"),
    ("bsd-2-clause", "opensource org", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource org", "opensource org licenses? bsd 3 clause"),
    ("apache-2", "opensource org", "opensource org licenses? apache 2 0"),
    ("gpl-2", "opensource org", "opensource org licenses? gpl 2 0"),
    ("gpl-3", "opensource org", "opensource org licenses? gpl 3 0"),
    ("mpl-2", "opensource org", "opensource org licenses? mpl 2 0"),
    ("artistic-2", "opensource org", "opensource org licenses? artistic(?: license)? 2 0"),
    ("apache-2", "apache org licenses", "apache org licenses license 2 0(?: txt| html)?"),
    ("apache-1.1", "apache org licenses", "apache org licenses license 1 1"),
    ("gpl-2", "gnu org", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "gnu org", "gnu org licenses gpl 3 0"),
    ("gpl", "gnu org", "gnu org licenses gpl"),
    ("lgpl-2.1", "gnu org", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "gnu org", "gnu org licenses lgpl 3 0"),
    ("lgpl", "gnu org", "gnu org licenses lgpl"),
    ("agpl-3", "gnu org", "gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", "gnu org", "gnu org licenses fdl(?: 1 [1-3])?"),
    ("mpl-2", "mozilla org", "mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla org", "mozilla org (?:en us )?mpl 1 1"),
    ("epl-1", "eclipse org", "eclipse org legal epl v10"),
    ("epl-2", "eclipse org", "eclipse org legal epl (?:v20|2 0)"),
    ("bsl-1", "boost org", "boost org license 1 0 txt"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "wtfpl net", "wtfpl net"),
    ("ofl-1.1", "scripts sil org", "scripts sil org ofl"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("public-domain", "creativecommons org publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("odbl-1", "opendatacommons org", "opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons org", "opendatacommons org licenses by"),
    ("pddl-1", "opendatacommons org", "opendatacommons org licenses pddl"),
    ("sspl-1", "mongodb com", "mongodb com licensing server side public license"),
    ("elastic-2", "elastic co", "elastic co licensing elastic license"),
    ("busl-1.1", "mariadb com", "mariadb com bsl11"),
    ("cc0", "spdx org licenses", "spdx org licenses cc0 1 0"),
    ("mit", "spdx org licenses", "spdx org licenses mit"),
    ("apache-2", "spdx org licenses", "spdx org licenses apache 2 0"),
    ("mit", "choosealicense com", "choosealicense com licenses mit"),
    ("apache-2", "choosealicense com", "choosealicense com licenses apache 2 0"),
    ("gpl-3", "choosealicense com", "choosealicense com licenses gpl 3 0"),
)
#: Labels of notices that say little about terms: their sentences have a low confidence.
VAGUE = ("proprietary", "public-domain", "cc")
RULE = "array<struct<keyword:string,pattern:string,label:string,priority:int,place:int,confidence:double>>"
FOUND = "array<struct<start:int,end:int,priority:int,place:int,label:string,confidence:double>>"


def rules() -> list[tuple[str, str, str, int, int, float]]:
    """Keyword, pattern, label, priority, place and confidence of every rule, in order of place."""
    made = [(f" {key}" if kind != "identifier" else " spdx", around.format(id=ident, name=name), label, priority, confidence) for kind, priority, confidence, around in SETTINGS for label, key, ident, name in FAMILIES]
    made += [(f" {key}", pattern, label, 1, 0.5 if label in VAGUE else 0.98) for label, key, pattern in SENTENCES + CLAUSES]
    made += [(f" {key}", f"(?:https? )?(?:www )?{pattern}", label, 1, 0.9) for label, key, pattern in ADDRESSES]
    return [(key, f" (?:{pattern.removeprefix('(?:released|licensed|distributed|available)? ?')})(?= )", label, priority, place, confidence) for place, (key, pattern, label, priority, confidence) in enumerate(made)]


def gate() -> str:
    """A pattern that the word sequence matches if the keyword of any rule, or a base phrase, occurs.

    Keywords are branched by letter, so that a word is given up at the first letter that no keyword goes on with.
    """
    keys = {r[0] for r in rules()} | {f" {phrase}" for phrase, _ in BASE}
    shortest = {k for k in keys if not any(k != other and k.startswith(other) for other in keys)}

    def branch(tails: list[str]) -> str:
        if "" in tails:
            return ""
        if len(tails) == 1:
            return re.escape(tails[0])
        firsts = sorted({t[0] for t in tails})
        parts = [re.escape(c) + branch([t[1:] for t in tails if t[0] == c]) for c in firsts]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return branch(sorted(shortest))


def _rules() -> Column:
    """The rules as one constant, which the optimizer reads once."""
    names = ("keyword", "pattern", "label", "priority", "place", "confidence")
    return F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rules()])), RULE)


def _words_in(text: Column) -> Column:
    """Spaces in a piece of the word sequence, each of which stands before a word."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" ")))


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``licenses``: ``n_words``, ``base`` (every place of a base phrase: start, label) and ``found`` (detections
    that stand: word range, priority, place of the rule, label, confidence)."""
    df = df.drop("licenses")
    names = free(df, "body", "line", "every")
    body, seq, every_ = map(F.col, names)
    lower = F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    line = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), " "), F.lit(" "))
    rows = df.withColumn(names[0], whole_text(text)).withColumn(names[1], within(line, lambda x: F.when(x.rlike(gate()), x)))

    def places(phrase: str, label: str) -> Column:
        return F.transform(match_spans(seq, F.lit(f" {phrase}(?= )"), _words_in), lambda s: F.struct(s["start"].alias("start"), F.lit(label).alias("label")))

    base = F.concat(*(places(*x) for x in BASE))
    gated = F.filter(_rules(), lambda r: F.contains(seq, r["keyword"]))
    every = F.flatten(F.transform(gated, lambda r: F.transform(match_spans(seq, r["pattern"], _words_in), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["priority"].alias("priority"), r["place"].alias("place"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
    none = F.array().cast(FOUND)
    rows = rows.withColumn(names[2], F.when(seq.isNotNull(), every).otherwise(none))

    kept = standing(every_)
    found = F.struct(F.size(F.regexp_extract_all(body, F.lit(WORD), F.lit(0))).cast("long").alias("n_words"), F.when(seq.isNotNull(), F.array_sort(base)).otherwise(F.array().cast("array<struct<start:int,label:string>>")).alias("base"), kept.alias("found"))
    return rows.withColumn("licenses", found).drop(*names)


def standing(found: Column) -> Column:
    """The detections that no other one suppresses, in order.

    In order of start, and the longer first, whatever contains a detection stands before it; so one scan for the
    last end of each priority decides, in n log n.
    """
    ends = [f"p{p}" for p in range(len(SETTINGS))]
    # least first: start, then the longer, the stronger, the earlier rule
    event = "struct<start:int,back:int,priority:int,place:int,end:int,label:string,confidence:double>"
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["priority"].alias("priority"), s["place"].alias("place"), s["end"].alias("end"), s["label"].alias("label"), s["confidence"].alias("confidence"))).cast(f"array<{event}>"))

    def decide(events: Column) -> Column:
        last = scanned(F.transform(events, lambda s: F.struct(*(F.when(s["priority"] == p, s["end"]).alias(n) for p, n in enumerate(ends)))), lambda x, y: F.struct(*(F.greatest(x[n], y[n]).alias(n) for n in ends)), f"struct<{','.join(f'{n}:int' for n in ends)}>")

        def stands(b: Column) -> Column:
            def clear(s: Column, i: Column) -> Column:
                over = F.get(b, i - 1)
                strongest = F.greatest(*(F.when(s["priority"] >= p, over[n]) for p, n in enumerate(ends)))
                return (i == 0) | strongest.isNull() | (strongest < s["end"])

            return F.filter(events, clear)

        return within(last, stands)

    kept = F.transform(within(ordered, decide), lambda s: F.struct(*(s[n].alias(n) for n in ("start", "end", "priority", "place", "label", "confidence"))))
    return F.when(F.size(found) < 2, found).otherwise(F.array_sort(kept.cast(FOUND)))


def digest(df: DataFrame) -> DataFrame:
    base, found = F.col("licenses.base"), F.col("licenses.found")
    label = lambda x: x["label"]
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.greatest(F.coalesce(F.array_max(F.transform(found, lambda s: s["confidence"])), F.lit(0.0)), F.when(F.size(base) > 0, F.lit(0.9)).otherwise(F.lit(0.0)))
    return df.select(
        "doc_id",
        F.col("licenses.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).cast("long").alias("last_word"),
        joined(F.transform(base, label)).alias("base_labels"),
        joined(F.concat(F.transform(base, label), F.transform(found, label))).alias("labels"),
        best.alias("score"),
    )


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_licenses(documents(spark, sf_dir).select("doc_id", "text")))


QUERIES = {"op2_license_rules": op2_license_rules}
ORACLE_SQL: dict[str, str] = {}
