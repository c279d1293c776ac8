"""The ordered signature rules of the license scan, one a line.

A line is: tier, label, keyword, pattern.  Patterns are regular expressions over
a text's words (A-Z lower-cased, joined by single spaces), bounded by spaces or
the text's ends; N stands for any one word.  A rule runs only where its keyword
occurs; every match must contain the keyword (alternatives are divided by |).
Tiers: 0 wording of a license or grant, 1 tag or address, 2 name with version,
3 name, 4 clue.  Within a tier the earlier line comes first.
"""

from __future__ import annotations

RULES = """
0 mit            permission is hereby granted      permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
0 mit            the software is provided as is     the software is provided as is without warranty of any kind express or implied
0 isc            permission to use copy             permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0 mit-0          permission is hereby granted      permission is hereby granted free of charge to any person obtaining a copy N N N N N N N N to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
0 hpnd           permission to use copy             permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
0 bsd-2-clause   redistribution and use             redistribution and use in source and binary forms with or without modification are permitted
0 bsd-3-clause   endorse or promote                 may be used to endorse or promote products derived from this software without specific prior written permission
0 bsd-4-clause   advertising materials              all advertising materials mentioning features or use of this software must display the following acknowledge?ment
0 bsd-disclaimer provided by the copyright holders  this software is provided by the copyright holders and contributors as is
0 apache-2.0     you may not use this file          you may not use this file except in compliance with the license
0 apache-2.0     unless required by applicable law  unless required by applicable law or agreed to in writing software distributed under the license
0 apache-1.1     apache software foundation         this product includes software developed by the apache software foundation
0 gpl            free software                      this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
0 lgpl           free software                      this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
0 gpl            without any warranty               is distributed in the hope that it will be useful but without any warranty
0 gpl-3.0        either version 3                   either version 3 of the licen[cs]e or at your option any later version
0 gpl-2.0        either version 2                   either version 2 of the licen[cs]e or at your option any later version
0 gpl            copy of the gnu                    you should have received a copy of the gnu general public licen[cs]e
0 lgpl           copy of the gnu                    you should have received a copy of the gnu lesser general public licen[cs]e
0 agpl           copy of the gnu                    you should have received a copy of the gnu affero general public licen[cs]e
0 mpl-2.0        source code form                   this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2 0
0 mpl-1.1        contents of this file              the contents of this file are subject to the mozilla public licen[cs]e version 1 1
0 cddl           contents of this file              the contents of this file are subject to the terms of the common development and distribution licen[cs]e
0 epl            accompanying materials             this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
0 unlicense      unencumbered software              this is free and unencumbered software released into the public domain
0 unlicense      anyone is free to copy             anyone is free to copy modify publish use compile sell or distribute this software
0 wtfpl          do what the fuck                   you just do what the fuck you want to
0 zlib           altered source versions            altered source versions must be plainly marked as such
0 zlib           origin of this software            the origin of this software must not be misrepresented
0 bsl-1.0        boost software                     permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license|distributed under the boost software licen[cs]e version 1 0
0 postgresql     postgresql                         postgresql database management system formerly known as postgres
0 ofl-1.1        font software                      this font software is licensed under the sil open font licen[cs]e version 1 1
0 cc0-1.0        dedicated to the public domain     to the extent possible under law N N has waived all copyright N N N N dedicated to the public domain
0 cc0-1.0        waived all copyright               has waived all copyright and related or neighboring rights
0 public-domain  placed in the public domain        (?:has been|is|was|are|hereby) placed in the public domain
0 public-domain  released into the public domain    (?:has been|is|was|are|hereby) released into the public domain
0 beerware       buy me a beer                      you can buy me a beer in return
0 jsonlicense    shall be used for good             the software shall be used for good not evil
0 sleepycat      sleepycat                          redistributions in any form must be accompanied by information on how to obtain complete source code for the db software|sleepycat software inc
0 openssl        openssl project                    this product includes software developed by the openssl project
0 ssleay         eric young                         this product includes cryptographic software written by eric young
0 artistic       reasonable copying fee             you may charge a reasonable copying fee for any distribution of this package
0 libpng         libpng                             this copy of the libpng notices is provided for your convenience
0 curl           copyright and permission notice    copyright and permission notice copyright c N daniel stenberg
0 ijg            independent jpeg group             this software is based in part on the work of the independent jpeg group
0 freetype       freetype                           portions of this software are copyright N N the freetype project
0 proprietary    without prior written permission   may not be reproduced (?:N ){0,6}without (?:the )?prior written permission
0 proprietary    unauthorized copying               unauthorized copying of this file via any medium is strictly prohibited
0 proprietary    proprietary and confidential       proprietary and confidential
0 proprietary    trade secret                       (?:contains?|is a|are) (?:confidential and )?trade secrets? (?:of|belonging to)
0 all-permissive copying and distribution           copying and distribution of this file with or without modification are permitted in any medium without royalty
0 gfdl           free documentation                 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
1 mit            spdx license identifier            spdx license identifier mit
1 mit-0          spdx license identifier            spdx license identifier mit 0
1 apache-2.0     spdx license identifier            spdx license identifier apache 2 0
1 gpl-2.0        spdx license identifier            spdx license identifier gpl 2 0(?: only)?
1 gpl-2.0+       spdx license identifier            spdx license identifier gpl 2 0 or later
1 gpl-3.0        spdx license identifier            spdx license identifier gpl 3 0(?: only)?
1 gpl-3.0+       spdx license identifier            spdx license identifier gpl 3 0 or later
1 lgpl-2.1       spdx license identifier            spdx license identifier lgpl 2 1(?: only)?
1 lgpl-2.1+      spdx license identifier            spdx license identifier lgpl 2 1 or later
1 lgpl-3.0       spdx license identifier            spdx license identifier lgpl 3 0(?: only| or later)?
1 agpl-3.0       spdx license identifier            spdx license identifier agpl 3 0(?: only| or later)?
1 bsd-2-clause   spdx license identifier            spdx license identifier bsd 2 clause
1 bsd-3-clause   spdx license identifier            spdx license identifier bsd 3 clause
1 mpl-2.0        spdx license identifier            spdx license identifier mpl 2 0
1 epl-1.0        spdx license identifier            spdx license identifier epl 1 0
1 epl-2.0        spdx license identifier            spdx license identifier epl 2 0
1 isc            spdx license identifier            spdx license identifier isc
1 zlib           spdx license identifier            spdx license identifier zlib
1 unlicense      spdx license identifier            spdx license identifier unlicense
1 cc0-1.0        spdx license identifier            spdx license identifier cc0 1 0
1 cc-by-4.0      spdx license identifier            spdx license identifier cc by 4 0
1 cc-by-sa-4.0   spdx license identifier            spdx license identifier cc by sa 4 0
1 bsl-1.0        spdx license identifier            spdx license identifier bsl 1 0
1 ofl-1.1        spdx license identifier            spdx license identifier ofl 1 1
1 artistic-2.0   spdx license identifier            spdx license identifier artistic 2 0
1 eupl-1.2       spdx license identifier            spdx license identifier eupl 1 2
1 wtfpl          spdx license identifier            spdx license identifier wtfpl
1 apache-2.0     apache org licenses                (?:www )?apache org licenses license 2 0
1 apache-1.1     apache org licenses                (?:www )?apache org licenses license 1 1
1 gpl-2.0        gnu org                            (?:www )?gnu org licenses (?:old licenses )?gpl 2 0
1 gpl-3.0        gnu org                            (?:www )?gnu org licenses gpl 3 0
1 gpl            gnu org                            (?:www )?gnu org (?:licenses|copyleft) gpl
1 lgpl-2.1       gnu org                            (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1
1 lgpl-3.0       gnu org                            (?:www )?gnu org licenses lgpl 3 0
1 agpl-3.0       gnu org                            (?:www )?gnu org licenses agpl 3 0
1 gfdl           gnu org                            (?:www )?gnu org licenses fdl(?: 1 [123])?
1 mit            opensource org licenses            (?:www )?opensource org licenses mit(?: license(?: php)?)?
1 bsd-2-clause   opensource org licenses            (?:www )?opensource org licenses bsd 2 clause
1 bsd-3-clause   opensource org licenses            (?:www )?opensource org licenses bsd 3 clause
1 isc            opensource org licenses            (?:www )?opensource org licenses isc
1 mpl-2.0        mozilla org                        (?:www )?mozilla org mpl 2 0
1 mpl-1.1        mozilla org                        (?:www )?mozilla org mpl(?: mpl 1 1)?
1 epl-1.0        eclipse org legal                  (?:www )?eclipse org legal epl v10
1 epl-2.0        eclipse org legal                  (?:www )?eclipse org legal epl (?:v20|2 0)
1 bsl-1.0        boost org                          (?:www )?boost org license 1 0(?: txt)?
1 ofl-1.1        scripts sil org                    scripts sil org ofl
1 unlicense      unlicense org                      (?:www )?unlicense org
1 wtfpl          wtfpl net                          (?:www )?wtfpl net
1 cc0-1.0        creativecommons org publicdomain   (?:www )?creativecommons org publicdomain zero 1 0
1 cc-pdm         creativecommons org publicdomain   (?:www )?creativecommons org publicdomain mark 1 0
1 cc-by-4.0      creativecommons org licenses       (?:www )?creativecommons org licenses by 4 0
1 cc-by-3.0      creativecommons org licenses       (?:www )?creativecommons org licenses by 3 0
1 cc-by-2.0      creativecommons org licenses       (?:www )?creativecommons org licenses by 2 [05]
1 cc-by-sa-4.0   creativecommons org licenses       (?:www )?creativecommons org licenses by sa 4 0
1 cc-by-sa-3.0   creativecommons org licenses       (?:www )?creativecommons org licenses by sa 3 0
1 cc-by-sa-2.0   creativecommons org licenses       (?:www )?creativecommons org licenses by sa 2 [05]
1 cc-by-nc-4.0   creativecommons org licenses       (?:www )?creativecommons org licenses by nc 4 0
1 cc-by-nc-3.0   creativecommons org licenses       (?:www )?creativecommons org licenses by nc 3 0
1 cc-by-nd-4.0   creativecommons org licenses       (?:www )?creativecommons org licenses by nd 4 0
1 cc-by-nd-3.0   creativecommons org licenses       (?:www )?creativecommons org licenses by nd 3 0
1 cc-by-nc-sa-4.0 creativecommons org licenses      (?:www )?creativecommons org licenses by nc sa 4 0
1 cc-by-nc-sa-3.0 creativecommons org licenses      (?:www )?creativecommons org licenses by nc sa 3 0
1 cc-by-nc-nd-4.0 creativecommons org licenses      (?:www )?creativecommons org licenses by nc nd 4 0
1 cc-by-nc-nd-3.0 creativecommons org licenses      (?:www )?creativecommons org licenses by nc nd 3 0
2 apache-2.0     apache                             (?:the )?apache (?:software )?licen[cs]e (?:v|version )?2(?: 0)?
2 apache-2.0     apache                             apache (?:v2|2 0)(?: licen[cs]ed?)?
2 apache-2.0     apache                             apache licen[cs]e v2(?: 0)?
2 apache-1.1     apache                             (?:the )?apache (?:software )?licen[cs]e (?:v|version )?1 1
2 apache-1.0     apache                             (?:the )?apache (?:software )?licen[cs]e (?:v|version )?1 0
2 gpl-2.0        general public                     (?:gnu )?general public licen[cs]e (?:v|version )?2(?: 0)?
2 gpl-3.0        general public                     (?:gnu )?general public licen[cs]e (?:v|version )?3(?: 0)?
2 gpl-2.0        general public                     (?:gnu )?general public licen[cs]e v2
2 gpl-3.0        general public                     (?:gnu )?general public licen[cs]e v3
2 gpl-1.0        general public                     (?:gnu )?general public licen[cs]e (?:v|version )?1(?: 0)?
2 gpl-2.0+       general public                     version 2 or later of the (?:gnu )?general public licen[cs]e
2 gpl-3.0+       general public                     version 3 or later of the (?:gnu )?general public licen[cs]e
2 lgpl-2.1       lesser general public              (?:gnu )?lesser general public licen[cs]e (?:v|version )?2 1
2 lgpl-3.0       lesser general public              (?:gnu )?lesser general public licen[cs]e (?:v|version )?3(?: 0)?
2 lgpl-2.0       library general public             (?:gnu )?library general public licen[cs]e (?:v|version )?2(?: 0)?
2 agpl-3.0       affero general public              (?:gnu )?affero general public licen[cs]e (?:v|version )?3(?: 0)?
2 gpl-2.0        gpl                                (?:gnu )?gpl (?:v|version )?2(?: 0)?
2 gpl-3.0        gpl                                (?:gnu )?gpl (?:v|version )?3(?: 0)?
2 gpl-2.0        gplv2                              (?:gnu )?gplv2
2 gpl-3.0        gplv3                              (?:gnu )?gplv3
2 gpl-2.0+       gplv2                              gplv2 or (?:any )?later
2 gpl-3.0+       gplv3                              gplv3 or (?:any )?later
2 lgpl-2.1       lgpl                               (?:gnu )?lgpl (?:v|version )?2 1
2 lgpl-3.0       lgpl                               (?:gnu )?lgpl (?:v|version )?3(?: 0)?
2 lgpl-2.1       lgplv2                             (?:gnu )?lgplv2(?: 1)?
2 lgpl-3.0       lgplv3                             (?:gnu )?lgplv3
2 agpl-3.0       agpl                               (?:gnu )?agpl (?:v|version )?3(?: 0)?
2 agpl-3.0       agplv3                             (?:gnu )?agplv3
2 bsd-2-clause   bsd                                bsd (?:2|two) clause(?: licen[cs]e)?
2 bsd-2-clause   clause bsd                         (?:2|two) clause bsd(?: licen[cs]e)?
2 bsd-3-clause   bsd                                bsd (?:3|three) clause(?: licen[cs]e)?
2 bsd-3-clause   clause bsd                         (?:3|three) clause bsd(?: licen[cs]e)?
2 bsd-4-clause   bsd                                bsd (?:4|four) clause(?: licen[cs]e)?
2 bsd-4-clause   clause bsd                         (?:4|four) clause bsd(?: licen[cs]e)?
2 bsd-3-clause   bsd license                        (?:new|modified|revised) bsd license
2 bsd-2-clause   bsd license                        (?:simplified|freebsd) bsd license
2 bsd-4-clause   bsd license                        (?:old|original) bsd license
2 bsd-0-clause   bsd                                (?:0|zero) clause bsd(?: licen[cs]e)?|bsd (?:0|zero) clause|0bsd
2 mpl-2.0        mozilla public                     mozilla public licen[cs]e (?:v|version )?2(?: 0)?
2 mpl-1.1        mozilla public                     mozilla public licen[cs]e (?:v|version )?1 1
2 mpl-1.0        mozilla public                     mozilla public licen[cs]e (?:v|version )?1 0
2 mpl-2.0        mpl                                mpl (?:v|version )?2(?: 0)?
2 mpl-1.1        mpl                                mpl (?:v|version )?1 1
2 epl-1.0        eclipse public                     eclipse public licen[cs]e (?:v|version )?1(?: 0)?
2 epl-2.0        eclipse public                     eclipse public licen[cs]e (?:v|version )?2(?: 0)?
2 cddl-1.0       common development                 common development and distribution licen[cs]e (?:v|version )?1(?: 0)?
2 cddl-1.1       common development                 common development and distribution licen[cs]e (?:v|version )?1 1
2 cpl-1.0        common public                      common public licen[cs]e (?:v|version )?1(?: 0)?
2 eupl-1.1       european union public              european union public licen[cs]e (?:v|version )?1 1
2 eupl-1.2       european union public              european union public licen[cs]e (?:v|version )?1 2
2 artistic-1.0   artistic                           (?:perl )?artistic licen[cs]e (?:v|version )?1(?: 0)?
2 artistic-2.0   artistic                           artistic licen[cs]e (?:v|version )?2(?: 0)?
2 afl-3.0        academic free                      academic free licen[cs]e (?:v|version )?3(?: 0)?
2 osl-3.0        open software                      open software licen[cs]e (?:v|version )?3(?: 0)?
2 ofl-1.1        open font                          (?:sil )?open font licen[cs]e (?:v|version )?1 1
2 bsl-1.0        boost software                     boost software licen[cs]e (?:v|version )?1(?: 0)?
2 busl-1.1       business source                    business source licen[cs]e (?:v|version )?1 1
2 sspl-1.0       server side public                 server side public licen[cs]e (?:v|version )?1(?: 0)?
2 elastic-2.0    elastic license                    elastic license (?:v|version )?2(?: 0)?
2 zpl-2.1        zope public                        zope public licen[cs]e (?:v|version )?2 1
2 lppl-1.3c      latex project public               latex project public licen[cs]e (?:v|version )?1 3c?
2 odbl-1.0       open database                      open (?:data commons open )?database licen[cs]e (?:odbl )?(?:v|version )?1(?: 0)?
2 ms-pl          microsoft public                   microsoft public licen[cs]e
2 ms-rl          microsoft reciprocal               microsoft reciprocal licen[cs]e
2 nposl-3.0      non profit open software           non profit open software licen[cs]e 3 0
2 cc0-1.0        cc0                                cc0 (?:v|version )?1(?: 0)?(?: universal)?
2 cc-by-4.0      cc by                              cc by (?:v|version )?4(?: 0)?
2 cc-by-3.0      cc by                              cc by (?:v|version )?3(?: 0)?
2 cc-by-2.0      cc by                              cc by (?:v|version )?2(?: [05])?
2 cc-by-sa-4.0   cc by sa                           cc by sa (?:v|version )?4(?: 0)?
2 cc-by-sa-3.0   cc by sa                           cc by sa (?:v|version )?3(?: 0)?
2 cc-by-sa-2.0   cc by sa                           cc by sa (?:v|version )?2(?: [05])?
2 cc-by-nc-4.0   cc by nc                           cc by nc (?:v|version )?4(?: 0)?
2 cc-by-nc-3.0   cc by nc                           cc by nc (?:v|version )?3(?: 0)?
2 cc-by-nc-2.0   cc by nc                           cc by nc (?:v|version )?2(?: [05])?
2 cc-by-nd-4.0   cc by nd                           cc by nd (?:v|version )?4(?: 0)?
2 cc-by-nd-3.0   cc by nd                           cc by nd (?:v|version )?3(?: 0)?
2 cc-by-nc-sa-4.0 cc by nc sa                       cc by nc sa (?:v|version )?4(?: 0)?
2 cc-by-nc-sa-3.0 cc by nc sa                       cc by nc sa (?:v|version )?3(?: 0)?
2 cc-by-nc-nd-4.0 cc by nc nd                       cc by nc nd (?:v|version )?4(?: 0)?
2 cc-by-nc-nd-3.0 cc by nc nd                       cc by nc nd (?:v|version )?3(?: 0)?
2 cc-by-4.0      creative commons                   creative commons attribution 4(?: 0)?(?: international)?
2 cc-by-3.0      creative commons                   creative commons attribution 3(?: 0)?(?: unported)?
2 cc-by-sa-4.0   creative commons                   creative commons attribution share ?alike 4(?: 0)?(?: international)?
2 cc-by-sa-3.0   creative commons                   creative commons attribution share ?alike 3(?: 0)?(?: unported)?
2 cc-by-nc-4.0   creative commons                   creative commons attribution non ?commercial 4(?: 0)?(?: international)?
2 cc-by-nd-4.0   creative commons                   creative commons attribution no ?deriv(?:ative)?s 4(?: 0)?(?: international)?
2 cc-by-nc-sa-4.0 creative commons                  creative commons attribution non ?commercial share ?alike 4(?: 0)?(?: international)?
2 cc-by-nc-nd-4.0 creative commons                  creative commons attribution non ?commercial no ?deriv(?:ative)?s 4(?: 0)?(?: international)?
3 mit            mit license|mit licence            (?:the )?mit licen[cs]e
3 mit            mit licensed                       mit licensed
3 mit            expat license                      (?:the )?expat license
3 x11            x11 license                        (?:the )?(?:mit )?x11 license
3 apache         apache license|apache licence      (?:the )?apache (?:software )?licen[cs]e
3 apache         apache software license            (?:the )?apache software license
3 bsd            bsd license|bsd licence            (?:the )?bsd licen[cs]e
3 bsd            bsd style                          bsd style(?: licen[cs]e)?
3 bsd            berkeley software                  berkeley software distribution
3 isc            isc license                        (?:the )?isc license
3 lgpl           lesser general public              (?:gnu )?lesser general public licen[cs]e
3 lgpl           library general public             (?:gnu )?library general public licen[cs]e
3 agpl           affero general public              (?:gnu )?affero general public licen[cs]e
3 gpl            gnu general public                 gnu general public licen[cs]e
3 gpl            gnu gpl                            gnu gpl
3 lgpl           gnu lgpl                           gnu lgpl
3 agpl           gnu agpl                           gnu agpl
3 gpl            gpl licensed|gpl license           gpl licensed?
3 gfdl           free documentation                 (?:gnu )?free documentation licen[cs]e
3 mpl            mozilla public                     mozilla public licen[cs]e
3 epl            eclipse public                     eclipse public licen[cs]e
3 cddl           common development                 common development and distribution licen[cs]e
3 cpl            common public                      common public licen[cs]e
3 eupl           european union public              european union public licen[cs]e
3 artistic       artistic license|artistic licence  (?:the )?artistic licen[cs]e
3 zlib           zlib license                       (?:the )?zlib(?: libpng)? license
3 libpng         libpng license                     (?:the )?libpng license
3 bsl            boost software                     (?:the )?boost software licen[cs]e
3 busl           business source                    business source licen[cs]e
3 sspl           server side public                 server side public licen[cs]e
3 unlicense      the unlicense                      the unlicense
3 wtfpl          do what the fuck                   do what the fuck you want to public licen[cs]e
3 ofl            open font                          (?:sil )?open font licen[cs]e
3 python         python software foundation         python software foundation licen[cs]e
3 php            php license                        (?:the )?php license
3 ruby           ruby license                       (?:the )?ruby license
3 postgresql     postgresql license                 (?:the )?postgresql license
3 openssl        openssl license                    (?:the )?openssl license
3 ncsa           university of illinois             university of illinois ncsa open source licen[cs]e
3 upl            universal permissive               universal permissive licen[cs]e
3 w3c            w3c                                w3c (?:software|document)(?: and document)?(?: notice and)? licen[cs]e
3 odbl           open database                      open database licen[cs]e
3 osl            open software                      open software licen[cs]e
3 afl            academic free                      academic free licen[cs]e
3 qpl            q public                           q public licen[cs]e
3 cecill         cecill                             cecill(?: [abc])?(?: licen[cs]e)?
3 lppl           latex project public               latex project public licen[cs]e
3 cc-by-sa       cc by sa                           cc by sa
3 cc-by-nc       cc by nc                           cc by nc
3 cc-by-nd       cc by nd                           cc by nd
3 cc-by-nc-sa    cc by nc sa                        cc by nc sa
3 cc-by-nc-nd    cc by nc nd                        cc by nc nd
3 cc0            creative commons zero              creative commons zero
3 cc-by          creative commons                   creative commons attribution(?: licen[cs]e)?
3 cc-by-sa       creative commons                   creative commons attribution share ?alike(?: licen[cs]e)?
3 cc-by-nc       creative commons                   creative commons attribution non ?commercial(?: licen[cs]e)?
3 cc             creative commons                   creative commons licen[cs]e
3 public-domain  public domain                      (?:in|into|to) the public domain
3 proprietary    proprietary license                proprietary license
3 freeware       freeware                           freeware licen[cs]e|licensed as freeware
3 shareware      shareware                          shareware licen[cs]e|licensed as shareware
4 copyright      copyright                          copyright (?:c|©) ?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9]){0,9}
4 copyright      copyright                          copyright (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9]){0,9}
4 copyright      ©                                  © (?:19|20)[0-9][0-9]
4 license-notice licensed under                     licensed under (?:the )?(?:terms of )?(?:the )?(?:N ){0,4}licen[cs]e
4 license-notice released under                     released under (?:the )?(?:terms of )?(?:the )?(?:N ){0,4}licen[cs]e
4 license-notice distributed under                  distributed under (?:the )?(?:terms of )?(?:the )?(?:N ){0,4}licen[cs]e
4 license-notice available under                    available under (?:the )?(?:terms of )?(?:the )?(?:N ){0,4}licen[cs]e
4 license-notice see license                        see (?:the )?license(?: file)? for (?:details|more information|licensing)
4 license-notice license file                       see (?:the )?(?:accompanying )?license file
4 license-notice dual licensed                      dual licensed(?: under)?
4 license-notice license agreement                  end user license agreement
"""


def parsed() -> list[tuple[int, str, tuple[str, ...], str]]:
    """(tier, label, keywords, pattern) of each rule, in order."""
    out = []
    for line in RULES.strip().splitlines():
        tier, label, rest = line.split(None, 2)
        keywords, pattern = rest.split("  ", 1)
        out.append((int(tier), label, tuple(keywords.split("|")), pattern.strip().replace("N", r"[^ ]{1,40}")))
    return out
