"""Compressed vectors of the two XPRESS forms.  Each is (name,
Huffman form, compressed bytes in hexadecimal, text that repeats, size)."""

VECTORS = [
    ('Plain0: all literals', False, "0000000047484f53542f2f5245434f5645522064617461207265636f7665727920656e67ffffff01696e6565722e0a", b'GHOST//RECOVER data recovery engineer.\n', 39),
    ('Plain1: the MS-XCA worked example, 100 copies of abc', False, "ffffff1f61626317000fff2601", b'abc', 300),
    ('Plain2: nibble-encoded length (49 copies of P)', False, "ffffff7f5007000f17", b'P', 49),
    ('Plain3: byte-encoded length (300 copies of A)', False, "ffffff7f4107000fff2801", b'A', 300),
    ('Plain4: LE16 length (4002 copies of Q)', False, "ffffff7f5107000fff9e0f", b'Q', 4002),
    ('Plain5: two matches in one flag group', False, "ffff3f006162636465666768696a4f000fff1f01", b'abcdefghij', 300),
    ('Plain6: shared half-byte between two matches', False, "ffff27006162636465666768696a4f00c078790f00", b'abcdefghijabcdefghijxyxyxyxyxyxyxyxyxyxyxyxy', 44),
    ('Plain7: literal between two shared-nibble matches', False, "ffffff0b6d6e6f701f00ff035a070107", b'mnopmnopmnopmnopmnopmnopmnopmnopZmnopmnopmnopmnopmnopmnopmnopmnop', 65),
    ('Plain8: LE32 length (70000 copies of W)', False, "ffffff7f570700fffffcffffffff6d11", b'W', 70000),
    ('Plain9: large offset (6000 copies of a 22-byte phrase)', False, "ff030000303132333435363738396162636465666768696a6b6caf00fffffcffbffffffcffbfff0fff8903", b'0123456789abcdefghijkl', 132000),
    ('PlainNib1: length 11', False, "ffffff7f6e070000", b'n', 11),
    ('PlainNib2: length 12', False, "ffffff7f6e070001", b'n', 12),
    ('PlainNib3: length 13', False, "ffffff7f6e070002", b'n', 13),
    ('PlainNib4: length 14', False, "ffffff7f6e070003", b'n', 14),
    ('PlainNib5: length 15', False, "ffffff7f6e070004", b'n', 15),
    ('PlainNib6: length 16', False, "ffffff7f6e070005", b'n', 16),
    ('PlainNib7: length 17', False, "ffffff7f6e070006", b'n', 17),
    ('PlainNib8: length 18', False, "ffffff7f6e070007", b'n', 18),
    ('PlainNib9: length 19', False, "ffffff7f6e070008", b'n', 19),
    ('PlainNib10: length 20', False, "ffffff7f6e070009", b'n', 20),
    ('PlainNib11: length 21', False, "ffffff7f6e07000a", b'n', 21),
    ('PlainNib12: length 22', False, "ffffff7f6e07000b", b'n', 22),
    ('PlainNib13: length 23', False, "ffffff7f6e07000c", b'n', 23),
    ('PlainNib14: length 24', False, "ffffff7f6e07000d", b'n', 24),
    ('PlainByte1: length 26', False, "ffffff7f6207000f00", b'b', 26),
    ('PlainByte25: length 50', False, "ffffff7f6207000f18", b'b', 50),
    ('PlainByte75: length 100', False, "ffffff7f6207000f4a", b'b', 100),
    ('PlainByte125: length 150', False, "ffffff7f6207000f7c", b'b', 150),
    ('PlainByte175: length 200', False, "ffffff7f6207000fae", b'b', 200),
    ('PlainByte225: length 250', False, "ffffff7f6207000fe0", b'b', 250),
    ('PlainByte254: length 279', False, "ffffff7f6207000ffd", b'b', 279),
    ('PlainSharedHalfByteAcrossLiteral', False, "ffffff5f41070021420700", b'AAAAAAAAAAAABBBBBBBBBBBBB', 25),
    ('Anchor', False, "ffff0000413142324333443445354636473748387f000fd7", b'A1B2C3D4E5F6G7H8', 256),
    ('Huff0', True, "00000000000000000000000000000000030000000000000500000000000000000000000000000000000006000000000050665555666555456555556555050000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000500000000000000000000000000000000000000000000000000000000000000050000000000000000000000000000500000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000b4e3a98f5ee7628ebc5fac284719404298aaeb897cda205c6196e4b6ff38010000", b'The quick brown fox jumps over the lazy dog. ', 360),
    ('Huff1', True, "0000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000003033030000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000020000000000000000000000000000000000000000000020000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000074970000ff7925", b'abcd', 9600),
    ('Huff2', True, "0000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000002000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000010000000000002000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000b00000ffb40b", b'z', 3000),
    ('Huff3', True, "8888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888880800070000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000800000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000014072e21483b62557c6f9689b0a3cabde4d7fef11b0e35284f42695c83769d90b7aad1c4ebde08f822153c2f564970638a7da497beb1d8cbf2e50f02291c43365d50776a9184ab9ec5b8dfd2f9ec160930234a3d64577e71988bb2a5ccbfe6d903f31d10372a51446b5e85789f92b9acd3c6ede00afa24173e31584b72658c7fa699c0b3dacdf4e711042b1e45385f52796c9386ada0c7bae1d4fbee180b32254c3f665980739a8db4a7cec1e8db05f51f12392c53466d60877aa194bbaed5c8efe20cfc261940335a4d74678e81a89bc2b5dccff6e913062d20473a61547b6e9588afa2c9bce3d6fdf01a0d34274e41685b82759c8fb6a9d0c3eaddfff700faff204d0000", b'\x05\x12\x1f,9FS`mz\x87\x94\xa1\xae\xbb\xc8\xd5\xe2\xef\xfc\x0c\x19&3@MZgt\x81\x8e\x9b\xa8\xb5\xc2\xcf\xdc\xe9\xf6\x06\x13 -:GTan{\x88\x95\xa2\xaf\xbc\xc9\xd6\xe3\xf0\x00\r\x1a\'4AN[hu\x82\x8f\x9c\xa9\xb6\xc3\xd0\xdd\xea\xf7\x07\x14!.;HUbo|\x89\x96\xa3\xb0\xbd\xca\xd7\xe4\xf1\x01\x0e\x1b(5BO\\iv\x83\x90\x9d\xaa\xb7\xc4\xd1\xde\xeb\xf8\x08\x15"/<IVcp}\x8a\x97\xa4\xb1\xbe\xcb\xd8\xe5\xf2\x02\x0f\x1c)6CP]jw\x84\x91\x9e\xab\xb8\xc5\xd2\xdf\xec\xf9\t\x16#0=JWdq~\x8b\x98\xa5\xb2\xbf\xcc\xd9\xe6\xf3\x03\x10\x1d*7DQ^kx\x85\x92\x9f\xac\xb9\xc6\xd3\xe0\xed\xfa\n\x17$1>KXer\x7f\x8c\x99\xa6\xb3\xc0\xcd\xda\xe7\xf4\x04\x11\x1e+8ER_ly\x86\x93\xa0\xad\xba\xc7\xd4\xe1\xee\xfb\x0b\x18%2?LYfs\x80\x8d\x9a\xa7\xb4\xc1\xce\xdb\xe8\xf5', 20000),
    ('Huff4', True, "0000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000200000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000010000000000002000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000b00000fffcff", b'x', 65536),
    ('Huff5', True, "0000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000200000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000010000000000002000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000b0000002", b'x', 21),
    ('Huff6', True, "000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000505555555555454444440400000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000004000000000000000000000000000000000000000000000000000000000000000000000000000040000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000006da5677ce75bf07d341279560048020000", b'abcdefghijklmnopqrst', 40),
]
