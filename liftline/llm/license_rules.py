"""Wordings of license bodies, headers, deeds and agreements, written by hand, over lower-case words.

Each is a regex that begins with a plain word; words are parted by one space. A wording without a label, under the
empty name, is a negative rule: it suppresses what lies within it and gives no label itself.
"""

from __future__ import annotations

_L = "licen[cs]e"
_CC = "(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"

BODIES = {
    "": [
        *(f"{x} {_L} (?:plates?|numbers?|keys?|fees?|servers?|holders?|renewals?)" for x in ("mit", "apache", "bsd", "isc", "boost", "elastic", "ruby", "expat", "artistic", "zlib", "w3c")),
        *(f"{x} artistic {_L}" for x in ("some", "much", "little", "took", "take", "takes", "taking", "taken", "with", "poetic and")),
        f"artistic {_L} with the (?:facts|truth|history|story|plot|text)",
        *(f"not {x} the public domain" for x in ("released in", "released into", "released to", "placed in", "placed into", "yet in", "dedicated to")),
        "never released into the public domain", "never placed in the public domain",
        *(f"not {x} under (?:the |a |an )?(?:gnu )?(?:gpl|lgpl|agpl|general public|mit|apache|bsd)(?: {_L})?" for x in ("licensed", "licenced", "released")),
        "no proprietary information of", "nothing proprietary and confidential",
    ],
    "agpl": [
        "interacting with it remotely through a computer network", "remote network interaction use with the gnu general public",
        "you should have received a copy of the gnu affero general public", "redistribute it and or modify it under the terms of the gnu affero general public",
        "ensure cooperation with the community in the case of network server software",
    ],
    "all-rights-reserved": ["all rights reserved", "all rights are reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados"],
    "apache": [
        "licensed to the apache software foundation asf", f"you may not use this file except in compliance with the {_L}",
        f"see the {_L} for the specific language governing permissions and limitations", f"unless required by applicable law or agreed to in writing software distributed under the {_L}",
        "this product includes software developed by the apache software foundation", "apache org licenses", "www apache org licenses",
        f"subject to the terms and conditions of this {_L} each contributor hereby grants to you a perpetual worldwide non exclusive",
    ],
    "artistic": ["standard version of the package", "copyright holder of the package and derivatives", "reasonable copying fee"],
    "as-is": [
        "the software is provided as is without warranty of any kind", "this software is provided as is without warranty of any kind", "provided as is without warranty of any kind",
        "provided as is without any warranty", "provided as is and any express or implied warranties", "there is no warranty for the program to the extent permitted by applicable law",
        "in no event shall the authors or copyright holders be liable", "in no event shall the author be liable", "in no event will the authors be held liable",
        "in no event shall the copyright (?:holder|holders|owner) or contributors be liable", "in no event unless required by applicable law or agreed to in writing will any copyright holder",
        "disclaims all warranties with regard to this software", "disclaim all warranties with regard to this software", "use at your own risk without warranty",
    ],
    "beerware": ["beer ware " + _L, "beerware " + _L, "you can buy me a beer in return", "buy me a beer in return"],
    "blue-oak": ["blue oak model " + _L, "blueoak 1 0 0"],
    "bsd": [
        "this software is provided by the copyright holders and contributors", "this software is provided by the regents and contributors", "this software is provided by the author and contributors",
        "this list of conditions and the following disclaimer", "all advertising materials mentioning features or use of this software", "neither the name of the copyright holder nor the names of its contributors",
        "new bsd " + _L, "simplified bsd " + _L, "modified bsd " + _L, "revised bsd " + _L, "freebsd " + _L, "clear bsd " + _L, "original bsd " + _L, "bsd style " + _L, "bsd like " + _L, "regents of the university of california",
    ],
    "bsl": ["boost org license", "www boost org license", "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement"],
    "busl": ["additional use grant", "business source licen[cs]e 1 1", f"change {_L} version [23]"],
    "cc-by": ["creative commons attribution [1234] [05]" + _CC, "creativecommons org licenses by [1234] [05]", "cc by (?:international|unported)"],
    "cc-by-nc": ["creative commons attribution non ?commercial [1234] [05]" + _CC, "creativecommons org licenses by nc [1234] [05]"],
    "cc-by-nc-nd": ["creative commons attribution non ?commercial no ?deriv(?:ative)?s? (?:works )?[1234] [05]" + _CC, "creativecommons org licenses by nc nd [1234] [05]"],
    "cc-by-nc-sa": ["creative commons attribution non ?commercial share ?alike [1234] [05]" + _CC, "creativecommons org licenses by nc sa [1234] [05]"],
    "cc-by-nd": ["creative commons attribution no ?deriv(?:ative)?s? (?:works )?[1234] [05]" + _CC, "creativecommons org licenses by nd [1234] [05]"],
    "cc-by-sa": ["creative commons attribution share ?alike [1234] [05]" + _CC, "creativecommons org licenses by sa [1234] [05]"],
    "cc0": ["creativecommons org publicdomain zero", "has waived all copyright and related or neighboring rights", "cc0 public domain", "creative commons zero v1 0 universal", "no copyright reserved under cc0"],
    "cddl": ["subject to the terms of the common development and distribution", "opensource org licenses cddl", "netbeans org cddl"],
    "cecill": ["governed by the cecill(?: [abc])? " + _L, "cecill(?: [abc])? " + _L + " under french law", "www cecill info"],
    "commons-clause": ["commons clause " + _L + " condition", "commons clause condition", "the license does not grant to you the right to sell the software"],
    "creative-commons": [
        "you must give appropriate credit provide a link to the " + _L, "you are free to share copy and redistribute the material in any medium or format", "no additional restrictions you may not apply legal terms or technological measures",
        f"this work is {_L}d under a creative commons", "some rights reserved", "creative commons corporation is not a law firm",
    ],
    "curl": ["curl " + _L],
    "ecl": [f"educational community {_L} version 2 0", "opensource org licenses ecl2"],
    "edl": ["eclipse distribution " + _L, "edl 1 0", "edlv1"],
    "elastic": ["you may not provide the software to third parties as a hosted or managed service", f"you may not move change disable or circumvent the {_L} key functionality"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public", "eclipse org legal epl", "www eclipse org legal epl", "secondary licenses when the conditions for such availability set forth in the eclipse public"],
    "eula": [
        f"end user {_L} agreement", f"end user software {_L} agreement", f"software {_L} agreement", f"this software is {_L}d not sold", f"the software is {_L}d not sold", "you may not reverse engineer decompile or disassemble",
        "by installing copying or otherwise using the software you agree", "by downloading or installing the software you agree", "by clicking i agree", "by clicking accept you agree",
        f"limited non exclusive non transferable {_L}", f"limited nonexclusive nontransferable {_L}", f"non exclusive non transferable {_L} to", "for evaluation purposes only", "rent lease lend sell redistribute or sublicense", "terms of service and end user",
    ],
    "eupl": ["licensed under the eupl", "european union public licence v", "joinup ec europa eu"],
    "fdl": ["with no invariant sections no front cover texts and no back cover texts", "invariant sections being list their titles", "front cover texts being", "gnu free documentation " + _L + " version"],
    "freetype": [f"freetype project {_L}", f"freetype {_L}", "portions of this software are copyright (?:\\S+ ){0,3}the freetype project"],
    "gnu": [
        f"everyone is permitted to copy and distribute verbatim copies of this {_L} document", "this program is distributed in the hope that it will be useful", "this library is distributed in the hope that it will be useful",
        "without even the implied warranty of merchantability or fitness for a particular purpose", "free software foundation inc 51 franklin", "free software foundation inc 59 temple place", "free software foundation inc 675 mass ave",
        f"either version [123](?: [01])? of the {_L} or at your option any later version", "or at your option any later version", "how to apply these terms to your new programs", "you may not impose any further restrictions on the exercise of the rights",
        "along with this program if not (?:see|write to)", "gnu org licenses", "www gnu org licenses", "copyleft",
    ],
    "gpl": [
        "you should have received a copy of the gnu general public", "the licenses for most software are designed to take away your freedom", "convey verbatim copies of the program s source code", "a covered work in object code form",
        f"the gnu general public {_L} is a free copyleft {_L}", "when we speak of free software we are referring to freedom not price", "protecting users legal rights from anti circumvention law", "this general public license applies to most of the free software foundation s software",
    ],
    "gpl-exception": ["classpath exception", "gcc runtime library exception", "bison exception", "autoconf exception", "linking this library statically or dynamically with other modules", "as a special exception the copyright holders of this", "as a special exception to the gnu general public", "font exception"],
    "hippocratic": ["hippocratic " + _L],
    "hpnd": ["permission to use copy modify and distribute this software and its documentation for any purpose is hereby granted without fee", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted", "historical permission notice and disclaimer"],
    "ibm-pl": ["ibm public " + _L],
    "icu": ["icu " + _L],
    "imagemagick": ["imagemagick " + _L],
    "isc": ["the above copyright notice and this permission notice appear in all copies"],
    "json": ["the software shall be used for good not evil", "json " + _L],
    "lgpl": [
        "you should have received a copy of the gnu lesser general public", "you should have received a copy of the gnu library general public", "work that uses the library", "a work based on the library", "works that use the library",
        "this license the lesser general public license applies to some specially designated software", "gnu lgpl (?:version )?(?:2 1|3)", "the combined work",
    ],
    "libtiff": ["permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that i"],
    "lppl": ["latex project org lppl", "www latex project org lppl", "this work has the lppl maintenance status", "distributed and or modified under the conditions of the latex project public"],
    "mit": ["the above copyright notice and this permission notice shall be included in all copies", "opensource org licenses mit", "www opensource org licenses mit", "mit style " + _L, "mit like " + _L, "x11 " + _L],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public", "if a copy of the mpl was not distributed with this file", "the contents of this file are subject to the mozilla public", "mozilla org mpl", "www mozilla org mpl",
        "incompatible with secondary licenses as defined by the mozilla public", f"covered software is provided under this {_L} on an as is basis",
    ],
    "mulan": ["mulan psl v[12]", "mulan permissive software " + _L, "license coscl org cn mulanpsl"],
    "noncommercial": ["you may not use the material for commercial purposes", "for non commercial use only", "for noncommercial use only", "non commercial purposes only", "noncommercial purposes only", "may not be used for commercial purposes"],
    "odbl": ["open database " + _L, "odbl 1 0", "odblv1", "opendatacommons org licenses odbl"],
    "odc-by": ["odc by 1 0", "open data commons attribution " + _L, "opendatacommons org licenses by"],
    "ofl": ["this font software is licensed under the sil open font", "scripts sil org ofl", "reserved font name", "no modified version of the font software may use"],
    "ogl": ["open government licen[cs]e", "contains public sector information licensed under the open government"],
    "openrail": ["openrail(?: m)?", "responsible ai " + _L, "bigscience rail " + _L, "creativeml open rail(?: m)?"],
    "openssl": ["openssl " + _L, "this product includes software developed by the openssl project", "this product includes cryptographic software written by eric young"],
    "oracle-bcl": ["oracle binary code " + _L, "sun microsystems inc binary code " + _L],
    "pddl": ["public domain dedication and " + _L, "pddl 1 0", "opendatacommons org licenses pddl"],
    "php": ["php " + _L, "this product includes php software"],
    "polyform": ["polyform (?:noncommercial|strict|shield|internal use|free trial|perimeter)", "polyform small business " + _L],
    "postgresql": ["provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "proprietary": [
        "no part of this (?:publication|document|book|work|file|software) may be reproduced", "without the prior written (?:permission|consent|approval) of", "without prior written (?:permission|consent|approval)",
        "without express written (?:permission|consent)", "without the express written (?:permission|consent)", "for internal use only", "strictly for internal use", "company confidential", "trade secrets? of", "contains trade secrets",
        "this file is part of a proprietary", "this software is proprietary", "commercial " + _L + " agreement", "this material is the confidential property of", "disclosure or use of this material is prohibited", "not for redistribution", "do not copy or distribute without permission",
    ],
    "psf": ["psf hereby grants licensee a nonexclusive royalty free", f"python software foundation {_L} version 2", "beopen com " + _L + " agreement for python", "cnri " + _L + " agreement for python"],
    "public-domain": ["creativecommons org publicdomain mark", "has been identified as being free of known restrictions under copyright law", "is hereby placed in the public domain", "is in the public domain", "are in the public domain", "hereby disclaims copyright to this", "the author disclaims copyright to this source code", "no rights reserved", "work of the united states government"],
    "rsa-md": ["rsa data security inc md[245] message digest algorithm"],
    "sgi": ["sgi free software " + _L],
    "share-alike": ["you must distribute your contributions under the same " + _L],
    "sleepycat": ["sleepycat " + _L, "sleepycat software inc all rights"],
    "source-available": ["source available " + _L, "source code is available for review only", "business friendly source available"],
    "sspl": ["offering the program as a service", "service source code means", "make the functionality of the program or a modified version available to third parties as a service"],
    "tcl": ["tcl tk " + _L, "tcl " + _L, "this software is copyrighted by the regents of the university of california sun microsystems"],
    "unicode": ["unicode " + _L, "unicode data files and any associated documentation", "unicode org copyright"],
    "unlicense": ["anyone is free to copy modify publish use compile sell or distribute this software", "unlicense org", "relinquish in perpetuity of all present and future rights to this software"],
    "vim": ["vim " + _L],
    "w3c": ["w3c software and document notice", "w3c document " + _L, "www w3 org consortium legal"],
    "wtfpl": ["www wtfpl net", "everyone is permitted to copy and distribute verbatim or modified copies of this " + _L + " document and changing it is allowed"],
    "xfree86": ["xfree86 " + _L, "xfree86 project inc"],
    "zend": ["zend engine " + _L],
    "zlib": ["the origin of this software must not be misrepresented", "this notice may not be removed or altered from any source distribution", "provided as is without any express or implied warranty", "zlib libpng " + _L],
    "zpl": ["zope public " + _L + " version"],
}
