"""Digests of the canonical form of whole public licence texts: with and without title, "All rights reserved."
and the appendix after the terms, and as the copies in circulation have them."""

from __future__ import annotations

# Licence, sha256 of licenses.canonical(licenses.canonical_lines(text)).
WHOLE = (
    ("0BSD", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("0BSD", "35c04e36cbd561c5b426fab4e84812826ba04258dc2859f780241153dea18a30"),
    ("0BSD", "3d7b7ce2a6e224f3ce2c959b8b26ed63938ae9ac89a1a93812c66acfe9971516"),
    ("0BSD", "5c6dd2680292a4d082875d7c36af5c2652bb260b209dfc5124224ec9efb9c67e"),
    ("0BSD", "5e19b64a719ef9785b8a1f6a2f174eb20769fa2d1721c9a7c5094bfa077cbe37"),
    ("0BSD", "7bbb2e567dd81aa759df88f81d5c4120cf9ddd7553352f43d77d9b9331579e0b"),
    ("0BSD", "9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153"),
    ("0BSD", "9f314a63752354aff9aa6acba3f8978efa4b5f5bbbb277a8f1475d0c14c3a6b7"),
    ("0BSD", "e2b2cf3822341e329b9ab67e1770a9bb9b076a1a97b8fc7ea305756836288ecc"),
    ("0BSD", "f52c11f14b7a7c6f487f572d6b8921f3f7967e83bf633653ce29480dc6c02a12"),
    ("Apache-2.0", "1bed9fad64305f9bbca5524dc8154dd51697db9d9cb58a22857a48cbd618979f"),
    ("Apache-2.0", "3fb1429ed830365d3e2fcd14ff7c09fa6aa420737f8c855c98ee4b2dca7ffc29"),
    ("Apache-2.0", "64bc47d65c625a074bfe4deb8661dccb57bc45e7aad314748e7201e8237df594"),
    ("Apache-2.0", "6f73510cebc7ccf648cf651365e345bd56598baf2d9ffaf025034ac4cb170285"),
    ("Apache-2.0", "9446b99128ec9c3946adbb681853599f3a5f01a69d6c0762a9d0ab699868d801"),
    ("Apache-2.0", "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0"),
    ("Apache-2.0", "bb531182159142b308d308fe34391e6848d93f2a2ed991087b686ec75f9dbb1d"),
    ("Apache-2.0", "c348fad4100086120c9a4f71602579f6f49d5ca97ae96d36cf377b10e6e79871"),
    ("Apache-2.0", "c46dfd45ed4a19fe4a99eaed08590a0c093e3a0b73c293ece466f468b902aff3"),
    ("Apache-2.0", "c936c3be4c0e23ce771b851922c44c2c6bbb0fb8c42f59ae99cf57ebd223697c"),
    ("Apache-2.0", "ccbc6f77c8bedabf96ab4a6835d70a5f018a7c8bd9bb7b626cecc3a73ed40511"),
    ("Apache-2.0", "eae86dc2a3c044d64f8aa6ebe7eba2bc43118ecde6504d61494e39e6e3656d13"),
    ("BSD-2-Clause", "07009138c2c60079b5c0af517b8bd8b4b42ffc843cc131a20d92d08a8f23f9fd"),
    ("BSD-2-Clause", "10677e704f35e9d68ab40192dc9035db9a743691d71ad0f39d1ae44a81d27e98"),
    ("BSD-2-Clause", "1cd2d4d633195ae0e7223a94a138f2ffeb48b5c1e6cbc2bd997dfae4cd96abd6"),
    ("BSD-2-Clause", "1d1a3f907ac2b8e243bdf9c51f92b3a187160678cb8f29c2a3ad0df897afe642"),
    ("BSD-2-Clause", "218f5b650f149e23f159537f8b1ab16d0ff44722e0038a34bb90a58b3442864a"),
    ("BSD-2-Clause", "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-2-Clause", "2c570d136b858b0a4d090e301862eacb53fb1ae2743462bf3b89e602191665f7"),
    ("BSD-2-Clause", "2d43d7fea89b3633b95184ddd4e7d55c0d384cc18515de6da01adef25b3a8439"),
    ("BSD-2-Clause", "2e9901df2d3cdd9b2ad2d0541a98d0ffe16ec6a54494b7837b493c08b3bde071"),
    ("BSD-2-Clause", "33903615089fdb3ab02696d1bd92eb9580c2c7a0e0c8714aa95b0dfc1dcdb89c"),
    ("BSD-2-Clause", "3851d34d50dcbb9256e3af58b5c99e83430619b6380f4adc9b118e7abf80bce6"),
    ("BSD-2-Clause", "3938f828c79910468f483f925e6a33217162693f71035d6044cbd04dc6fd1bd5"),
    ("BSD-2-Clause", "4038c3ccd5fa8753677529584c619d7c444b612a24f5b11ee38c5af912766141"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "4a5b45ed3ca9ae854c5505a774b3659d3852be9a3412b822802b3cdbe5dc7b0a"),
    ("BSD-2-Clause", "5d123f3d2076a6b22f7b17a92623627ef50d1584e8cf13b7d4040f1c6e8a0424"),
    ("BSD-2-Clause", "69cdbd21a2d990e706160e435568bdf1c22727c4ed2cab0cfaa1b78b3904ced3"),
    ("BSD-2-Clause", "6b311f1f82b5f7b5a0cc379e40c1da2c2edd9f71c6f479c30628d8b9b27ea691"),
    ("BSD-2-Clause", "712dce7d673ff7e1550976bfd879c441ad93a2d9906c3c4ae27441d29fa3350b"),
    ("BSD-2-Clause", "7acc61f0bd7743a1042c6d3379cd94a4a424b18f97fc7b342a2253b92e8082dc"),
    ("BSD-2-Clause", "7ff364231b3920929bc5aeb795343ae30f2aea77866054735ecb69e0e70f55b6"),
    ("BSD-2-Clause", "8906363799dbe7a6aff07f665d7698ad3e34b029f09df3d473bf1118a17a2f1f"),
    ("BSD-2-Clause", "8b28f63734bf310903015ecd26ae5c979f31743ca170703b95426d7203774453"),
    ("BSD-2-Clause", "8e9dce55587c09da7adb0f3cfc5a8497b73e26aad978f536499fc078a7f8892c"),
    ("BSD-2-Clause", "957c3854a3d72e069e7f5e48857ad9ab76135f14c70d60fa9ec6ef9a928d45dd"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "a11471bc40750a21bd4508891b5626642657a09eaa0ef1ec576be7d37fe5ada8"),
    ("BSD-2-Clause", "a15fcc0daac5f45ce67b8232a31ffb9da0dd18505ef702a3726b8d923d9971e9"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "a78184b2c67ed3906485a7e9161d724c95e04261082e06a27869e1753384b18c"),
    ("BSD-2-Clause", "aef99695204288c3828a4d0acd9e62a735a6c1781beaa3aee4aeb504f1f112db"),
    ("BSD-2-Clause", "b02d799e391838a73a0ccc75692ba88eafccab18abbd5f907e855d22048655d4"),
    ("BSD-2-Clause", "b5335fc56cb06fb488859427303188fdccfe901752d74938dbb3e63c952746a4"),
    ("BSD-2-Clause", "b7d49d651647319f38c254df78d020e1c773cbac121d97b17eb70bf3149e7233"),
    ("BSD-2-Clause", "b9578a124b7f83b06b28da656e009d5188b5c664c402b7c018c56cfaeb24b00a"),
    ("BSD-2-Clause", "bc1e385eb5d19c6613b84fb0a516cbaef80caefb192cf62a0c520c07f0fcab07"),
    ("BSD-2-Clause", "bf4cd629bb8a70e349537e8ca530dc88576938ec375a2ede8054a0ebaf7ae836"),
    ("BSD-2-Clause", "c5cb44b340dfa97436d18371e401686dddf3451388afa1a24c0e410cd7a38b24"),
    ("BSD-2-Clause", "cb19805eac283bd8cea786373cc0e19cabbf15bc4cbd572dc1efb3dbd05ca91d"),
    ("BSD-2-Clause", "d69394be0a847fe521c89264bf2e8cf6ecfd61bb44868747d2184929f1ddf3b9"),
    ("BSD-2-Clause", "d8273d18414549823077df21707b29ce7fb0661f8dd82fdb4b3632c3d07901fe"),
    ("BSD-2-Clause", "d9360b475bb35dc9bce111eec4d3be1faa67ed2a3a561f03ad44e73b4993919a"),
    ("BSD-2-Clause", "e74f02edf06350e22d771b60d0580c53e28783fd12eda06abd03dab1348bc9d9"),
    ("BSD-2-Clause", "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9"),
    ("BSD-2-Clause", "eda2ad636e738f6a26a2fea902bb734ee48c789a5b40035b8db3659bd951e5bc"),
    ("BSD-2-Clause", "f38fa2034bf54944a35dd1ff3703481e42a97c80896b1db58621ba8ec98c2048"),
    ("BSD-2-Clause", "f4befedc01589c90d5effeae5f64453726c8fded8e4b6fe6c36f99d303581f1f"),
    ("BSD-2-Clause", "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b"),
    ("BSD-3-Clause", "007fde9b266f35183b511c8c01994581175bfdaa48438967e905c31fb50ba523"),
    ("BSD-3-Clause", "02cbb88221e507a296bab4438d8c41fc55a45c1e486982b72971ef667bab440e"),
    ("BSD-3-Clause", "05a95c87273b8ac5ee9d58ec8c08d5c112dcbb31aa59cfd5b5e845702f640418"),
    ("BSD-3-Clause", "07002ede2e559c6e97a5ba89a53d7ded83eda46c54cea64eb39745675c2aabfc"),
    ("BSD-3-Clause", "0cf5a72c5293e66fcaa8496e5a3e135ac28e2ee23128bfc4fab72cc0934bb675"),
    ("BSD-3-Clause", "0fd715971b9eef40682d457e9b18f9eb0bdde1b640847b28593e4094f8871915"),
    ("BSD-3-Clause", "109f433fa6d7ddc201aa2bf2527bac4f38143cdcf2ea093dfa07d89074bec856"),
    ("BSD-3-Clause", "1238550805feaeec7ac6f60c2a1b7b3828c3fb1e9d9d52c718c3b75c7b5ff98e"),
    ("BSD-3-Clause", "14c74613c04ea95836287e807ac4917f2ed4c10d2e06252eb8e6db7fe57926af"),
    ("BSD-3-Clause", "19a4781693c27171941c3997100df63b3707e99f2135091c98fb3aba3429a921"),
    ("BSD-3-Clause", "1b9c2fc92ea32d1c705d689163d6e1783efd910af0262514c4185cad11fefe75"),
    ("BSD-3-Clause", "1ff3b3240bfd8d2489ef0dbe1e93c248a1ea92c6753dd367dd21dab256a80e21"),
    ("BSD-3-Clause", "214aa9c28152d6d77e6bebfb4a7511e677f65fdaf94b0fe9c0bb580e0eaf8997"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "220781d65cabba526c5f2c828bc0b2be5176762067699c3a6a1d990c34e288e7"),
    ("BSD-3-Clause", "22293313803f608fe4cf24a6f1419c435d8b8ee43e458011eb2abca759cf571f"),
    ("BSD-3-Clause", "2cdd19f933f323a30eebbe32aec8e6b66920a61bb8015563b953e080ecd5fb6c"),
    ("BSD-3-Clause", "2d5cf1096f2b14581168916887ed8dbd2474b628882f261f4e64f1c452445bf7"),
    ("BSD-3-Clause", "2e7176bc5e672ddac2a5f0fc6d960e21a16fec090b3cbc11632a75ec99e63ee9"),
    ("BSD-3-Clause", "326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903"),
    ("BSD-3-Clause", "39bc19d2e32c4824fe446a931672e4ee8ceee7bf191f76bf6c99140b01c64550"),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("BSD-3-Clause", "3f60f0cdf78f0a92c80fac67aa6cd8641363b5b786d18f78a1122a6db9a6b96b"),
    ("BSD-3-Clause", "4079d1a9108ca437dd29ac26e1f73dbf7bb3b61ba3392438373db7018cf188c3"),
    ("BSD-3-Clause", "418027c022345ec370b1c9271eb22b5c5f6670ba86ef8ef468346b0236ff635c"),
    ("BSD-3-Clause", "4e9ad430816ef99d7c5e6f810b75a4656b10387721550916a7e39572d8d9f186"),
    ("BSD-3-Clause", "4fec7901c0764f1c632da504aa28d5de5e7e5f0783c88d1e3fd21de4f97e315d"),
    ("BSD-3-Clause", "52708ae7496bad323efc341f2b977f4deecc250729644235974381dbffa10b45"),
    ("BSD-3-Clause", "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", "58be4a6ecb08608c7ca4f693f84d0c16cc60b34e8f47a0a3555ff27911901613"),
    ("BSD-3-Clause", "5a2a789d3e539c6419b99449d506cdb442ff86f4bc70a376a2dbf45467861f83"),
    ("BSD-3-Clause", "5a6e7ec0b1ac1e224277a8a6d5cd7691ea38298b0308b87a7a2e539d020ed1e0"),
    ("BSD-3-Clause", "5e25105305b8ef7a192c36467627f72073d80915ac9b916f40edfc8309fa5979"),
    ("BSD-3-Clause", "69c80ecd667962a5396a7709e22ffa9b1e242f82b600ace35cb9fce6e2db5ae7"),
    ("BSD-3-Clause", "69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71"),
    ("BSD-3-Clause", "6cd2ec4c1707d264427cffd6a4120fb4ce726f221152e3e5c63f8b57d2e1693e"),
    ("BSD-3-Clause", "6e5ff3a5e17bf78bc2302e3f5b9d296c357ef3a5760035e625deb6e953d1e58b"),
    ("BSD-3-Clause", "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da"),
    ("BSD-3-Clause", "7aea53c0d7a37e67b5b48bc0173358fa13cce6248e39e0f781aa1f29758b4c03"),
    ("BSD-3-Clause", "7b3d31be6c146cd9333d28a51513235c2fcc35fddff3eb68853e448c76aa40ea"),
    ("BSD-3-Clause", "7b57614be5d1abd5826bb4b7096a1d2f91fdc92e36f49112bf162ea0ced57045"),
    ("BSD-3-Clause", "7c16b387b2fd67aea7403110df9457eea9844b938eda62df5f98a56797001ccf"),
    ("BSD-3-Clause", "84c781b5d7e3445d472ea78f86da8ce1f7cf3f8a699eed9e76e2fde2284fa9b6"),
    ("BSD-3-Clause", "855155cf519f9ea91ae5dc0a9d038cbc74dc2b0bd855c828628544adf05a5445"),
    ("BSD-3-Clause", "899ada18e2040c10bdd0cdcb8744444fd6eeced0e4a911ea594da3903381d78b"),
    ("BSD-3-Clause", "91ac11f4f00a65b8efdaf9acd840fb61dee7a83cdbd51b27a0939b4188201497"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "9b9ac51f5ca1f4f99ccf94a0770c77723a9b4a5eaf09e0de3f8c9ec65b1f396d"),
    ("BSD-3-Clause", "9c07b35bff4c7723f05498d5016671e6aab167812efed57d22d711c2877f486b"),
    ("BSD-3-Clause", "9cd680d56db42f3a510ba3089570ba3abf28066291ae57ecf32e4d67e6527310"),
    ("BSD-3-Clause", "a5a967f1089352270e4c31843b08f4a8cb5615200b01391336132c121e184d3e"),
    ("BSD-3-Clause", "a98dcf53df2bd8167b86d686bd31e35ec3ce68b6547752821db35a456f3ad5bb"),
    ("BSD-3-Clause", "aafd6e0ab2463685c4010db700e4ddd38c69950335a1d2fb0370caa4211bca6f"),
    ("BSD-3-Clause", "ab96d546e6cc543d5b4293c719e371f5b0d14297d55a21baa6643452a92007ce"),
    ("BSD-3-Clause", "c5e3da532699e38cf476422d333a1294d3c4ea9636bab723d6d2ae7ab6e275ba"),
    ("BSD-3-Clause", "ca799e073f3e5e2ad4c06cf7dd1e32c2807290c6ca0fddb7096a95815626bd44"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "ceb539a14a135648f303dbe38b2f990c43786bd70c95bbbfa427010d5444ec1f"),
    ("BSD-3-Clause", "cf77ee3d20f4076cecdb58fc53aa7204c9f5c0651621abbc85e028f5b2ffa6b4"),
    ("BSD-3-Clause", "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060"),
    ("BSD-3-Clause", "d82f2ad54d92522ca9f29d754cffb4f11620b35003ae61d3f79be2f2ae6f7fc1"),
    ("BSD-3-Clause", "da336ff5d6bbb6a30ad59a0dd798c7e6e1e57d719bbb6300725786c3648c658d"),
    ("BSD-3-Clause", "dd9c572087f92a74232343008a70468eeee08d97112450db549eb0fb33a8d29e"),
    ("BSD-3-Clause", "e0a2092139c370f402284efaf452317f36b6cf859e5aadc058eb21b6e63bebeb"),
    ("BSD-3-Clause", "e651765ec94c99c2ea03cf19aceb85785d656ba08685eb0772747c296340cb54"),
    ("BSD-3-Clause", "e851b8ac25522e6982d24c61a1d845c8b52c6daf5a88c0a1212098fba27a7ddd"),
    ("BSD-3-Clause", "eabe215ff5a2cf5b1c090915b7cabdf511f70fc79fb8fde85247ebe3038a9658"),
    ("BSD-3-Clause", "eba25c920ebc89a341dcbe90d79a9b187642283bfc026f8d9e9b3bfdc72d8bd0"),
    ("BSD-3-Clause", "ed0104d130ef02966836b3c8fb16c58ca9a91d49ed78ed3281531b463296f124"),
    ("BSD-3-Clause", "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("BSD-3-Clause", "fc9261937567ed0c0a24ab83f1957183333cfa72a7b53dc9f5f4815309c0872d"),
    ("BSD-3-Clause", "fcfaca9856c9d06723391332be070f14157dc455699d40c8852a50b70f45fada"),
    ("CC-BY-SA-4.0", "6fd32d7fe30fa66c101714769c97e3e375bdf90cc19532508e2dfb4d98a92a9d"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-2.0", "031ce0347a7bfaa9fea9fb34dc0def0f70d366e9b6aeab50cf9537178d0d9d50"),
    ("GPL-2.0", "3417af4a4eb07583be14c0185e9a1834057e320931de2c5bf39c217a03fe79a0"),
    ("GPL-2.0", "42a2063beecb82de51a227e52a22e4acf4fa0d052827262e6bb57835e02e10e9"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "71f3bc98cacf711b6e2ff997b37641e59cc5bf623e7c0f0e8343aed2626f4ec9"),
    ("GPL-2.0", "724c8299687866f11de217ce9f08e16805bc84b71e66d8c4ea1307d371e33a4f"),
    ("GPL-2.0", "949d7b0a70d9281ea0bb37fd8aa082f26cd4efcfbb376d0dccad043e772c09a0"),
    ("GPL-2.0", "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75"),
    ("GPL-2.0", "bdf38469899e13b914cf4555a4606ddcc8b2faddcedc662286f649b36212f225"),
    ("GPL-2.0", "c2eea7a9d82a254e540a96d8107801d93d00bcef2742a78b7e8e8d0c0efcbd1c"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "9faf4f9b13ca844eeee37346a77dec74f558096ac2b418782a99c8afe4c772da"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db"),
    ("ISC", "5456fff23cf44064ff54d9d973cf8a7204e2788759d3d01ba3de38afc4515eee"),
    ("ISC", "71e638daa9a9b5572892642ad3b2898d7860124998d2bff139e1f88d7dd38679"),
    ("ISC", "83381f2ba91f8b4b5a524e928f0229510a7656a35772582d1c5e0f3ac5112220"),
    ("ISC", "86cadf6b8ff9a33f9f1268672376624474ebcae80a1a08747115581a22146101"),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("ISC", "fd4e450e334b5e7722a9cb4a5ef92dda5eeb172eeee17b631a720d12591461b1"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "4f163e21ac81a5bb5b92c19ede75a32428e1338af052850b5a7c1162f56ca800"),
    ("LGPL-2.1", "5db6a0cf025514ea4a904dd0c2731b3a48aec5259d5f1ec782685806040d7b6a"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "e8569a0bd486071c6889615f7a331a9c15914f9f684e92e729d2b90d5bed08f9"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "00a5c934b705d69594539c6a37a1105192217249a30fe111a375560a492639c9"),
    ("MIT", "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MIT", "8cde46b543036122641d289a848d3900df55f9efa471b2ff7354da3a6e4a113d"),
    ("MIT", "95d6e15f26b09973979cc939f067e143dab922c3ae8273ea44b568d429da0660"),
    ("MIT", "fb691d28b64b2a306b30449f04b63780c13263eccc568cc65d7f25fe9748dba2"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
)
