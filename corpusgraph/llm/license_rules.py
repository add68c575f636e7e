"""Signatures of licenses, written by hand. A line is: kind, label, keyword, and a pattern over words.

Words are as ``licenses`` cuts them (A-Z lowered, so "Apache-2.0" is ``apache 2 0``); a space stands between two words
that follow each other whatever lies between them in the text. Only groups, alternatives and ``?`` are used, so a match
is found in one pass. The keyword is a word that every match holds; of those, a rare one. Kinds, in order of priority:

``tag`` machine-readable identifiers, ``notice`` sentences that grant or disclaim, ``title`` names with a version,
``name`` names without one, ``mention`` abbreviations and addresses.
"""

from __future__ import annotations

from dataclasses import dataclass

KINDS = ("tag", "notice", "title", "name", "mention")

_LINES = r"""
tag     gpl-1.0          spdx          spdx license identifier gpl 1 0(?: only| or later)?
tag     gpl-2.0          spdx          spdx license identifier gpl 2 0(?: only)?
tag     gpl-2.0-or-later spdx          spdx license identifier gpl 2 0 or later
tag     gpl-3.0          spdx          spdx license identifier gpl 3 0(?: only)?
tag     gpl-3.0-or-later spdx          spdx license identifier gpl 3 0 or later
tag     lgpl-2.0         spdx          spdx license identifier lgpl 2 0(?: only| or later)?
tag     lgpl-2.1         spdx          spdx license identifier lgpl 2 1(?: only| or later)?
tag     lgpl-3.0         spdx          spdx license identifier lgpl 3 0(?: only| or later)?
tag     agpl-3.0         spdx          spdx license identifier agpl 3 0(?: only| or later)?
tag     gfdl             spdx          spdx license identifier gfdl 1 [123](?: only| or later)?
tag     apache-1.1       spdx          spdx license identifier apache 1 1
tag     apache-2.0       spdx          spdx license identifier apache 2 0
tag     mit              spdx          spdx license identifier mit
tag     mit-0            spdx          spdx license identifier mit 0
tag     bsd-0-clause     spdx          spdx license identifier 0bsd
tag     bsd-1-clause     spdx          spdx license identifier bsd 1 clause
tag     bsd-2-clause     spdx          spdx license identifier bsd 2 clause
tag     bsd-3-clause     spdx          spdx license identifier bsd 3 clause
tag     bsd-3-clause-clear spdx        spdx license identifier bsd 3 clause clear
tag     bsd-4-clause     spdx          spdx license identifier bsd 4 clause
tag     mpl-1.1          spdx          spdx license identifier mpl 1 1
tag     mpl-2.0          spdx          spdx license identifier mpl 2 0
tag     epl-1.0          spdx          spdx license identifier epl 1 0
tag     epl-2.0          spdx          spdx license identifier epl 2 0
tag     eupl-1.2         spdx          spdx license identifier eupl 1 2
tag     cddl-1.0         spdx          spdx license identifier cddl 1 [01]
tag     isc              spdx          spdx license identifier isc
tag     zlib             spdx          spdx license identifier zlib
tag     boost-1.0        spdx          spdx license identifier bsl 1 0
tag     busl-1.1         spdx          spdx license identifier busl 1 1
tag     sspl-1.0         spdx          spdx license identifier sspl 1 0
tag     unlicense        spdx          spdx license identifier unlicense
tag     wtfpl            spdx          spdx license identifier wtfpl
tag     artistic-2.0     spdx          spdx license identifier artistic 2 0
tag     python-2.0       spdx          spdx license identifier (?:python 2 0|psf 2 0)
tag     ofl-1.1          spdx          spdx license identifier ofl 1 1
tag     cc0-1.0          spdx          spdx license identifier cc0 1 0
tag     cc-by-3.0        spdx          spdx license identifier cc by 3 0
tag     cc-by-4.0        spdx          spdx license identifier cc by 4 0
tag     cc-by-sa-3.0     spdx          spdx license identifier cc by sa 3 0
tag     cc-by-sa-4.0     spdx          spdx license identifier cc by sa 4 0
tag     cc-by-nc-4.0     spdx          spdx license identifier cc by nc 4 0
tag     cc-by-nd-4.0     spdx          spdx license identifier cc by nd 4 0
tag     cc-by-nc-sa-4.0  spdx          spdx license identifier cc by nc sa 4 0
tag     cc-by-nc-nd-4.0  spdx          spdx license identifier cc by nc nd 4 0
tag     odbl-1.0         spdx          spdx license identifier odbl 1 0
tag     odc-by-1.0       spdx          spdx license identifier odc by 1 0
tag     pddl-1.0         spdx          spdx license identifier pddl 1 0
tag     ms-pl            spdx          spdx license identifier ms pl
tag     ms-rl            spdx          spdx license identifier ms rl
tag     postgresql       spdx          spdx license identifier postgresql
tag     ncsa             spdx          spdx license identifier ncsa
tag     afl-3.0          spdx          spdx license identifier afl 3 0
tag     osl-3.0          spdx          spdx license identifier osl 3 0
tag     mulan-2.0        spdx          spdx license identifier mulanpsl 2 0
notice  gpl-2.0          gnu           under the terms of the gnu general public license as published by the free software foundation version 2(?: of the license)?
notice  gpl-2.0-or-later gnu           gnu general public license as published by the free software foundation either version 2(?: of the license)? or (?:at your option )?any later version
notice  gpl-3.0          gnu           under the terms of the gnu general public license as published by the free software foundation version 3(?: of the license)?
notice  gpl-3.0-or-later gnu           gnu general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version
notice  gpl-2.0          gnu           licensed under the (?:terms of the )?gnu general public license (?:version |v )?2(?: 0)?
notice  gpl-3.0          gnu           licensed under the (?:terms of the )?gnu general public license (?:version |v )?3(?: 0)?
notice  gpl-2.0          gplv2         (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gplv2
notice  gpl-3.0          gplv3         (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gplv3
notice  gpl              gpl           (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl
notice  lgpl-2.1-or-later gnu          gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or (?:at your option )?any later version
notice  lgpl-3.0-or-later gnu          gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version
notice  lgpl-2.0-or-later gnu          gnu library general public license as published by the free software foundation either version 2(?: of the license)? or (?:at your option )?any later version
notice  lgpl-2.1         gnu           licensed under the gnu lesser general public license (?:version |v )?2 1
notice  lgpl-3.0         gnu           licensed under the gnu lesser general public license (?:version |v )?3(?: 0)?
notice  agpl-3.0-or-later affero       gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version
notice  agpl-3.0         affero        licensed under the gnu affero general public license (?:version |v )?3(?: 0)?
notice  gfdl             documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
notice  apache-2.0       apache        licensed under the apache license version 2 0
notice  apache-2.0       apache        (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?apache (?:software )?(?:license )?(?:version |v )?2(?: 0)?
notice  apache-2.0       compliance    you may not use this file except in compliance with the license
notice  apache-2.0       basis         distributed on an as is basis without warranties or conditions of any kind
notice  apache-1.1       apache        this product includes software developed by the apache software foundation
notice  apache           apache        (?:released|distributed|available|licensed) under (?:the )?apache license
notice  mit              charge        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
notice  mit              portions      the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
notice  mit              merchantability the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
notice  mit              license       (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?mit license
notice  mit              licence       (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?mit licence
notice  bsd              redistribution redistribution and use in source and binary forms with or without modification are permitted
notice  bsd              redistributions redistributions of source code must retain the above copyright notice
notice  bsd              redistributions redistributions in binary form must reproduce the above copyright notice
notice  bsd-3-clause     endorse       neither the name of(?: the)?(?: [a-z0-9]+)?(?: [a-z0-9]+)?(?: [a-z0-9]+)? nor the names of its contributors may be used to endorse or promote products
notice  bsd-4-clause     advertising   all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
notice  bsd              bsd           (?:released|distributed|available|licensed) under (?:the |a )?(?:terms of the )?(?:new |modified |simplified |revised )?bsd (?:style )?license
notice  bsd-2-clause     bsd           (?:released|distributed|available|licensed) under (?:the |a )?(?:simplified bsd|bsd 2 clause|2 clause bsd) license
notice  bsd-3-clause     bsd           (?:released|distributed|available|licensed) under (?:the |a )?(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd) license
notice  isc              fee           permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
notice  isc              disclaims     the software is provided as is and the author disclaims all warranties with regard to this software
notice  isc              isc           (?:released|distributed|available|licensed) under (?:the )?isc license
notice  zlib             misrepresented the origin of this software must not be misrepresented
notice  zlib             altered       altered source versions must be plainly marked as such
notice  boost-1.0        boost         (?:distributed|licensed|released) under the boost software license(?: version 1 0)?
notice  mpl-1.1          mozilla       the contents of this file are subject to the mozilla public license version 1 1
notice  mpl-2.0          mozilla       this source code form is subject to the terms of the mozilla public license v 2 0
notice  mpl-2.0          mozilla       (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?mozilla public license (?:version |v )?2(?: 0)?
notice  epl-1.0          eclipse       made available under the terms of the eclipse public license (?:v |version )?1 0
notice  epl-2.0          eclipse       made available under the terms of the eclipse public license (?:v |version )?2 0
notice  epl-2.0          eclipse       (?:released|distributed|available|licensed) under (?:the )?eclipse public license (?:v |version )?2(?: 0)?
notice  eupl-1.2         eupl          licensed under the eupl(?: version 1 2| v 1 2)?
notice  cddl-1.0         cddl          subject to the terms of the common development and distribution license cddl
notice  unlicense        unencumbered  this is free and unencumbered software released into the public domain
notice  public-domain    domain        (?:released|placed|dedicated|is) (?:into |in |to )the public domain
notice  public-domain    disclaims     the author(?:s)? (?:hereby )?disclaims copyright to this source code
notice  wtfpl            wtfpl         (?:released|distributed|available|licensed) under (?:the )?wtfpl
notice  cc0-1.0          cc0           (?:released|distributed|available|licensed|dedicated) under (?:the )?(?:creative commons )?cc0(?: 1 0)?
notice  cc0-1.0          cc0           the person who associated a work with this deed has dedicated the work to the public domain by cc0
notice  cc-by-2.0        cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by 2 0
notice  cc-by-3.0        cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by 3 0
notice  cc-by-4.0        cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by 4 0
notice  cc-by-sa-2.0     cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by sa 2 0
notice  cc-by-sa-3.0     cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by sa 3 0
notice  cc-by-sa-4.0     cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by sa 4 0
notice  cc-by-nc-3.0     cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by nc 3 0
notice  cc-by-nc-4.0     cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by nc 4 0
notice  cc-by-nd-3.0     cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by nd 3 0
notice  cc-by-nd-4.0     cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by nd 4 0
notice  cc-by-nc-sa-3.0  cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by nc sa 3 0
notice  cc-by-nc-sa-4.0  cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by nc sa 4 0
notice  cc-by-nc-nd-4.0  cc            (?:released|distributed|available|licensed) under (?:a |the )?cc by nc nd 4 0
notice  cc-by-4.0        commons       licensed under (?:a |the )?creative commons attribution 4 0(?: international)?(?: license)?
notice  cc-by-sa-4.0     commons       licensed under (?:a |the )?creative commons attribution (?:share alike|sharealike) 4 0(?: international)?(?: license)?
notice  cc-by-nc-4.0     commons       licensed under (?:a |the )?creative commons attribution (?:non commercial|noncommercial) 4 0(?: international)?(?: license)?
notice  cc               commons       (?:released|distributed|available|licensed) under (?:a |the )?creative commons
notice  odbl-1.0         database      made available under the open database license
notice  odc-by-1.0       odc           made available under the odc attribution license
notice  ofl-1.1          sil           this font software is licensed under the sil open font license version 1 1
notice  proprietary      confidential  proprietary and confidential
notice  proprietary      unauthorized  unauthorized copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited
notice  proprietary      permission    no part of this (?:publication|book|work|document) may be reproduced(?: [a-z]+)?(?: [a-z]+)?(?: [a-z]+)? without (?:the )?prior (?:written )?permission
notice  all-rights-reserved reserved   all rights reserved
notice  all-rights-reserved vorbehalten alle rechte vorbehalten
notice  all-rights-reserved droits     tous droits réservés
notice  all-rights-reserved reservados todos los derechos reservados
notice  busl-1.1         busl          (?:released|distributed|available|licensed) under (?:the )?busl(?: 1 1)?
notice  sspl-1.0         sspl          (?:released|distributed|available|licensed) under (?:the )?(?:server side public license|sspl)(?: v1| version 1)?
notice  python-2.0       psf           psf is making python available to licensee on an as is basis
notice  openssl          openssl       this product includes software developed by the openssl project
notice  ncsa             illinois      permission is hereby granted(?: free of charge)? under the university of illinois(?: ncsa)? open source license
notice  postgresql       postgresql    (?:released|distributed|available|licensed) under (?:the )?postgresql license
notice  ms-pl            microsoft     this license governs use of the accompanying software(?: published by)? microsoft
notice  artistic-2.0     artistic      (?:released|distributed|available|licensed) under (?:the )?artistic license(?: 2 0)?
notice  perl             perl          (?:you can |you may )?redistribute it and or modify it under the same terms as perl itself
title   gpl-1.0          gnu           gnu general public license (?:version |v )?1(?: 0)?
title   gpl-2.0          gnu           gnu general public license (?:version |v )?2(?: 0)?
title   gpl-3.0          gnu           gnu general public license (?:version |v )?3(?: 0)?
title   gpl-2.0          gnu           gnu general public license v2(?: 0)?
title   gpl-3.0          gnu           gnu general public license v3(?: 0)?
title   gpl-2.0-or-later gnu           gnu general public license (?:version |v )?2(?: 0)? or (?:any )?later
title   gpl-3.0-or-later gnu           gnu general public license (?:version |v )?3(?: 0)? or (?:any )?later
title   lgpl-2.0         gnu           gnu library general public license (?:version |v )?2(?: 0)?
title   lgpl-2.1         gnu           gnu lesser general public license (?:version |v )?2 1
title   lgpl-3.0         gnu           gnu lesser general public license (?:version |v )?3(?: 0)?
title   agpl-1.0         affero        affero general public license (?:version |v )?1(?: 0)?
title   agpl-3.0         affero        (?:gnu )?affero general public license (?:version |v )?3(?: 0)?
title   gfdl             documentation gnu free documentation license (?:version |v )?1 [123]
title   apache-1.0       apache        apache (?:software )?license (?:version |v )?1 0
title   apache-1.1       apache        apache (?:software )?license (?:version |v )?1 1
title   apache-2.0       apache        apache (?:software )?license (?:version |v )?2(?: 0)?
title   mpl-1.0          mozilla       mozilla public license (?:version |v )?1 0
title   mpl-1.1          mozilla       mozilla public license (?:version |v )?1 1
title   mpl-2.0          mozilla       mozilla public license (?:version |v )?2(?: 0)?
title   epl-1.0          eclipse       eclipse public license (?:version |v )?1(?: 0)?
title   epl-2.0          eclipse       eclipse public license (?:version |v )?2(?: 0)?
title   eupl-1.1         european      european union public licen[cs]e (?:version |v )?1 1
title   eupl-1.2         european      european union public licen[cs]e (?:version |v )?1 2
title   cddl-1.0         cddl          common development and distribution license cddl (?:version |v )?1 0
title   cddl-1.1         cddl          common development and distribution license cddl (?:version |v )?1 1
title   cpl-1.0          common        common public license (?:version |v )?1 0
title   artistic-1.0     artistic      artistic license (?:version |v )?1 0
title   artistic-2.0     artistic      artistic license (?:version |v )?2 0
title   bsd-2-clause     bsd           bsd 2 clause (?:simplified )?license
title   bsd-2-clause     bsd           2 clause bsd license
title   bsd-3-clause     bsd           bsd 3 clause (?:new )?(?:or revised )?license
title   bsd-3-clause     bsd           3 clause bsd license
title   bsd-4-clause     bsd           (?:bsd 4 clause|4 clause bsd|original bsd) license
title   bsd-0-clause     bsd           (?:bsd zero clause|zero clause bsd) license
title   boost-1.0        boost         boost software license (?:version |v )?1 0
title   afl-3.0          academic      academic free license (?:version |v )?3 0
title   osl-3.0          osl           open software license osl (?:version |v )?3 0
title   ofl-1.1          sil           sil open font license (?:version |v )?1 1
title   busl-1.1         business      business source license (?:version |v )?1 1
title   sspl-1.0         server        server side public license (?:version |v )?1
title   odbl-1.0         database      open database license (?:version |v )?1 0
title   cc0-1.0          cc0           (?:creative commons )?cc0 1 0(?: universal)?
title   cc-by-1.0        cc            cc by 1 0
title   cc-by-2.0        cc            cc by 2 0
title   cc-by-2.5        cc            cc by 2 5
title   cc-by-3.0        cc            cc by 3 0
title   cc-by-4.0        cc            cc by 4 0
title   cc-by-sa-2.0     cc            cc by sa 2 0
title   cc-by-sa-2.5     cc            cc by sa 2 5
title   cc-by-sa-3.0     cc            cc by sa 3 0
title   cc-by-sa-4.0     cc            cc by sa 4 0
title   cc-by-nc-2.0     cc            cc by nc 2 0
title   cc-by-nc-3.0     cc            cc by nc 3 0
title   cc-by-nc-4.0     cc            cc by nc 4 0
title   cc-by-nd-2.0     cc            cc by nd 2 0
title   cc-by-nd-3.0     cc            cc by nd 3 0
title   cc-by-nd-4.0     cc            cc by nd 4 0
title   cc-by-nc-sa-3.0  cc            cc by nc sa 3 0
title   cc-by-nc-sa-4.0  cc            cc by nc sa 4 0
title   cc-by-nc-nd-3.0  cc            cc by nc nd 3 0
title   cc-by-nc-nd-4.0  cc            cc by nc nd 4 0
title   cc-by-3.0        commons       creative commons attribution 3 0
title   cc-by-4.0        commons       creative commons attribution 4 0(?: international)?
title   cc-by-sa-3.0     commons       creative commons attribution (?:share alike|sharealike) 3 0
title   cc-by-sa-4.0     commons       creative commons attribution (?:share alike|sharealike) 4 0(?: international)?
title   cc-by-nc-4.0     commons       creative commons attribution (?:non commercial|noncommercial) 4 0(?: international)?
title   cc-by-nd-4.0     commons       creative commons attribution (?:no derivatives|noderivatives) 4 0(?: international)?
title   cc-by-nc-sa-4.0  commons       creative commons attribution (?:non commercial|noncommercial) (?:share alike|sharealike) 4 0(?: international)?
title   cc-by-nc-nd-4.0  commons       creative commons attribution (?:non commercial|noncommercial) (?:no derivatives|noderivatives) 4 0(?: international)?
name    gpl              gnu           gnu general public licen[cs]e
name    lgpl             gnu           gnu (?:lesser|library) general public licen[cs]e
name    agpl             affero        (?:gnu )?affero general public licen[cs]e
name    gfdl             documentation gnu free documentation licen[cs]e
name    apache           apache        apache (?:software )?licen[cs]e
name    mit              license       (?:the )?mit (?:x11 )?license
name    mit              licence       (?:the )?mit (?:x11 )?licence
name    x11              x11           x11 license
name    expat            expat         expat license
name    bsd              bsd           (?:new |modified |simplified |revised )?bsd (?:style )?licen[cs]e
name    isc              isc           isc licen[cs]e
name    zlib             zlib          zlib (?:libpng )?licen[cs]e
name    boost-1.0        boost         boost software license
name    mpl              mozilla       mozilla public licen[cs]e
name    epl              eclipse       eclipse public licen[cs]e
name    eupl             european      european union public licen[cs]e
name    cddl             distribution  common development and distribution license
name    artistic         artistic      artistic license
name    perl             perl          perl artistic license
name    python-2.0       python        python software foundation license
name    openssl          openssl       openssl license
name    ncsa             illinois      university of illinois ncsa open source license
name    postgresql       postgresql    postgresql licen[cs]e
name    ms-pl            microsoft     microsoft public license
name    ms-rl            microsoft     microsoft reciprocal license
name    unlicense        unlicense     (?:the )?unlicense
name    wtfpl            wtfpl         wtfpl
name    beerware         beer          beer ware license
name    public-domain    domain        public domain(?: dedication)?
name    cc               commons       creative commons(?: license)?
name    cc-by            commons       creative commons attribution(?: license)?
name    cc-by-sa         commons       creative commons attribution (?:share alike|sharealike)
name    cc-by-nc         commons       creative commons attribution (?:non commercial|noncommercial)
name    cc-by-nd         commons       creative commons attribution (?:no derivatives|noderivatives)
name    cc-by            cc            cc by
name    cc-by-sa         cc            cc by sa
name    cc-by-nc         cc            cc by nc
name    cc-by-nd         cc            cc by nd
name    cc-by-nc-sa      cc            cc by nc sa
name    cc-by-nc-nd      cc            cc by nc nd
name    odbl             database      open database licen[cs]e
name    odc-by           odc           odc attribution license
name    pddl             domain        public domain dedication and license
name    ofl              font          open font license
name    afl              academic      academic free license
name    osl              open          open software license
name    busl             business      business source license
name    sspl             server        server side public license
name    elastic-2.0      elastic       elastic license(?: 2 0| v2)?
name    commons-clause   clause        commons clause
name    mulan            mulan         mulan permissive software license
name    hippocratic      hippocratic   hippocratic license
name    openrail         openrail      (?:creativeml )?openrail(?: m)?(?: license)?
mention gpl-2.0          gplv2         gplv2
mention gpl-3.0          gplv3         gplv3
mention gpl              gpl           gpl(?: (?:v )?[123](?: 0)?)?
mention lgpl             lgpl          lgpl(?: (?:v )?[23](?: [01])?)?
mention lgpl-2.1         lgplv2        lgplv2(?: 1)?
mention lgpl-3.0         lgplv3        lgplv3
mention agpl             agpl          agpl(?: (?:v )?3(?: 0)?)?
mention agpl-3.0         agplv3        agplv3
mention gfdl             gfdl          gfdl
mention mpl-2.0          mpl           mpl 2 0
mention epl-2.0          epl           epl 2 0
mention cddl             cddl          cddl
mention eupl             eupl          eupl
mention gpl              gnu           (?:http |https )?(?:www )?gnu org (?:licenses|copyleft)(?: old licenses)?(?: gpl)?(?: html)?
mention apache-2.0       apache        (?:http |https )?(?:www )?apache org licenses license 2 0
mention mit              opensource    (?:http |https )?(?:www )?opensource org (?:licenses|license) mit
mention bsd-3-clause     opensource    (?:http |https )?(?:www )?opensource org (?:licenses|license) bsd 3 clause
mention mpl-2.0          mozilla       (?:http |https )?(?:www )?mozilla org mpl 2 0
mention epl              eclipse       (?:http |https )?(?:www )?eclipse org legal epl
mention boost-1.0        boost         (?:http |https )?(?:www )?boost org license 1 0 txt
mention unlicense        unlicense     (?:http |https )?unlicense org
mention cc-by            creativecommons (?:http |https )?(?:www )?creativecommons org licenses by(?: [1234] [05])?
mention cc-by-sa         creativecommons (?:http |https )?(?:www )?creativecommons org licenses by sa(?: [1234] [05])?
mention cc-by-nc         creativecommons (?:http |https )?(?:www )?creativecommons org licenses by nc(?: [1234] [05])?
mention cc-by-nd         creativecommons (?:http |https )?(?:www )?creativecommons org licenses by nd(?: [1234] [05])?
mention cc-by-nc-sa      creativecommons (?:http |https )?(?:www )?creativecommons org licenses by nc sa(?: [1234] [05])?
mention cc-by-nc-nd      creativecommons (?:http |https )?(?:www )?creativecommons org licenses by nc nd(?: [1234] [05])?
mention cc0-1.0          creativecommons (?:http |https )?(?:www )?creativecommons org publicdomain zero 1 0
mention odbl             opendatacommons (?:http |https )?(?:www )?opendatacommons org licenses odbl
"""


@dataclass(frozen=True)
class Rule:
    """``kind`` is an index into ``KINDS``; the number of a rule is its line."""

    kind: int
    label: str
    keyword: str
    pattern: str


def _read(line: str) -> Rule:
    kind, label, keyword, pattern = line.split(maxsplit=3)
    return Rule(KINDS.index(kind), label, keyword, pattern)


RULES = tuple(_read(line) for line in _LINES.strip().splitlines())
