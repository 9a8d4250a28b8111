"""Licence sentences by identifier, and licence rules as ordered sequences of them."""

SENTENCES = {
    # notices and references
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-project": "This project is licensed under the MIT License",
    "mit-software": "This software is released under the MIT License",
    "mit-name": "The MIT License",
    "mit-name-tag": "MIT License",
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-licensed-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-released": "Released under the Apache License 2.0",
    "apache-project": "This project is licensed under the Apache License 2.0",
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                     "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-licensed": "Licensed under the GNU General Public License v3.0",
    "gpl3-project": "This project is licensed under the GNU General Public License v3.0",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2",
    "gpl2-licensed": "Licensed under the GNU General Public License v2.0",
    "lgpl3-work": "This work is licensed under the GNU Lesser General Public License, version 3",
    "agpl3-work": "This work is licensed under the GNU Affero General Public License, version 3",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "bsd3-licensed": "Licensed under the BSD 3-Clause License",
    "bsd3-released": "Released under the BSD 3-Clause License",
    "bsd2-licensed": "Licensed under the BSD 2-Clause License",
    "bsd2-released": "Released under the BSD 2-Clause License",
    "isc-licensed": "Licensed under the ISC License",
    "unlicense-released": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc-by-licensed": "Licensed under CC BY 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-licensed": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-licensed": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-licensed": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-licensed": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd-licensed": "Licensed under CC BY-NC-ND 4.0",
    "cc0-dedicated": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "cc0-released": "Released under CC0 1.0",
    "all-rights-reserved": "All rights reserved",
    # sentences of full texts
    "permission-mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                      "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                      "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "notice-mit": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
                  "the Software",
    "warranty-mit": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
                    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "liability-mit": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
                     "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
                     "OR OTHER DEALINGS IN THE SOFTWARE",
    "permission-bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                      "the following conditions are met",
    "source-bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                  "disclaimer",
    "binary-bsd": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution",
    "endorse-bsd": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                   "products derived from this software without specific prior written permission",
    "permission-isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                      "granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-free": "This program is free software",
    "gpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                         "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                         "the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-merchant": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    # tags
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl3-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-gpl2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-mpl2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-cc0": "SPDX-License-Identifier: CC0-1.0",
}

# name of the rule: licence, sentences in order
RULES = {
    "mit-text": ("MIT", ["permission-mit", "notice-mit", "warranty-mit", "liability-mit"]),
    "mit-grant": ("MIT", ["permission-mit", "notice-mit"]),
    "mit-released": ("MIT", ["mit-released"]),
    "mit-licensed": ("MIT", ["mit-licensed"]),
    "mit-project": ("MIT", ["mit-project"]),
    "mit-software": ("MIT", ["mit-software"]),
    "mit-name": ("MIT", ["mit-name"]),
    "mit-name-tag": ("MIT", ["mit-name-tag"]),
    "mit-spdx": ("MIT", ["spdx-mit"]),
    "apache-header": ("Apache-2.0", ["apache-licensed-the", "apache-may-not", "apache-obtain", "apache-unless", "apache-see"]),
    "apache-short-header": ("Apache-2.0", ["apache-licensed-the", "apache-may-not"]),
    "apache-licensed": ("Apache-2.0", ["apache-licensed"]),
    "apache-licensed-the": ("Apache-2.0", ["apache-licensed-the"]),
    "apache-released": ("Apache-2.0", ["apache-released"]),
    "apache-project": ("Apache-2.0", ["apache-project"]),
    "apache-url": ("Apache-2.0", ["apache-url"]),
    "apache-spdx": ("Apache-2.0", ["spdx-apache"]),
    "gpl3-header": ("GPL-3.0-or-later", ["gpl-free", "gpl3-redistribute", "gpl-hope", "gpl-merchant", "gpl-details"]),
    "gpl3-grant": ("GPL-3.0-or-later", ["gpl-free", "gpl3-redistribute"]),
    "gpl2-header": ("GPL-2.0-or-later", ["gpl-free", "gpl2-redistribute", "gpl-hope", "gpl-merchant", "gpl-details"]),
    "gpl2-grant": ("GPL-2.0-or-later", ["gpl-free", "gpl2-redistribute"]),
    "gpl3-work": ("GPL-3.0-only", ["gpl3-work"]),
    "gpl3-licensed": ("GPL-3.0-only", ["gpl3-licensed"]),
    "gpl3-project": ("GPL-3.0-only", ["gpl3-project"]),
    "gpl3-spdx": ("GPL-3.0-only", ["spdx-gpl3"]),
    "gpl3-later-spdx": ("GPL-3.0-or-later", ["spdx-gpl3-later"]),
    "gpl2-work": ("GPL-2.0-only", ["gpl2-work"]),
    "gpl2-licensed": ("GPL-2.0-only", ["gpl2-licensed"]),
    "gpl2-spdx": ("GPL-2.0-only", ["spdx-gpl2"]),
    "lgpl3-work": ("LGPL-3.0-only", ["lgpl3-work"]),
    "agpl3-work": ("AGPL-3.0-only", ["agpl3-work"]),
    "mpl2-header": ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    "mpl2-subject": ("MPL-2.0", ["mpl2-subject"]),
    "mpl2-spdx": ("MPL-2.0", ["spdx-mpl2"]),
    "bsd3-text": ("BSD-3-Clause", ["permission-bsd", "source-bsd", "binary-bsd", "endorse-bsd"]),
    "bsd2-text": ("BSD-2-Clause", ["permission-bsd", "source-bsd", "binary-bsd"]),
    "bsd3-licensed": ("BSD-3-Clause", ["bsd3-licensed"]),
    "bsd3-released": ("BSD-3-Clause", ["bsd3-released"]),
    "bsd3-spdx": ("BSD-3-Clause", ["spdx-bsd3"]),
    "bsd2-licensed": ("BSD-2-Clause", ["bsd2-licensed"]),
    "bsd2-released": ("BSD-2-Clause", ["bsd2-released"]),
    "bsd2-spdx": ("BSD-2-Clause", ["spdx-bsd2"]),
    "isc-text": ("ISC", ["permission-isc"]),
    "isc-licensed": ("ISC", ["isc-licensed"]),
    "isc-spdx": ("ISC", ["spdx-isc"]),
    "unlicense-text": ("Unlicense", ["unlicense-released", "unlicense-anyone"]),
    "unlicense-released": ("Unlicense", ["unlicense-released"]),
    "cc-by-licensed": ("CC-BY-4.0", ["cc-by-licensed"]),
    "cc-by-work": ("CC-BY-4.0", ["cc-by-work"]),
    "cc-by-sa-licensed": ("CC-BY-SA-4.0", ["cc-by-sa-licensed"]),
    "cc-by-sa-work": ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    "cc-by-nc-licensed": ("CC-BY-NC-4.0", ["cc-by-nc-licensed"]),
    "cc-by-nc-work": ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    "cc-by-nd-licensed": ("CC-BY-ND-4.0", ["cc-by-nd-licensed"]),
    "cc-by-nc-sa-licensed": ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-licensed"]),
    "cc-by-nc-nd-licensed": ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-licensed"]),
    "cc0-dedicated": ("CC0-1.0", ["cc0-dedicated"]),
    "cc0-released": ("CC0-1.0", ["cc0-released"]),
    "cc0-spdx": ("CC0-1.0", ["spdx-cc0"]),
    "all-rights-reserved": ("LicenseRef-all-rights-reserved", ["all-rights-reserved"]),
}
